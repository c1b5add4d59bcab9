"""Document-curation engine expressed as Spark DataFrame plans."""
