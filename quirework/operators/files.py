"""The file store of artifacts: listings, verification, publication, usage, and what cleanup does with files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.urls import is_safe_path

#: How old an unreferenced file must be before it goes, and how long quarantine keeps one.
DAY_MS, PURGE_MS = 86_400_000, 7 * 86_400_000


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (relative to folder), byte_count, modified_ms of all files under a folder; their bytes are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select(_relative(F.col("path"), folder).alias("path"), F.col("length").alias("byte_count"), F.unix_millis("modificationTime").alias("modified_ms"))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, byte_count, sha256 of all files under a folder; only hashes leave the tasks that read them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select(_relative(F.col("path"), folder).alias("path"), F.col("length").alias("byte_count"), F.sha2("content", 256).alias("sha256"))


def _relative(path: Column, folder: str) -> Column:
    tail = folder.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return F.substring_index(path, tail, -1)


def text_files(spark: SparkSession, folder: str, most_bytes: int = 1_048_576, expected: DataFrame | None = None) -> DataFrame:
    """path, text, byte_count, error_code of UTF-8 files under a folder.

    TEXT_TOO_LARGE for more bytes than may be, TEXT_INVALID_UTF8 for bytes that are no text, and, with expected (path,
    byte_count, sha256), ARTIFACT_INTEGRITY_FAILED for files that are not what is expected.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(_relative(F.col("path"), folder).alias("path"), F.col("length").alias("byte_count"), "content")
    other = F.lit(False)
    if expected is not None:
        want = expected.select(F.col("path").alias("_path"), F.col("byte_count").alias("_bytes"), F.col("sha256").alias("_sha256"))
        rows = rows.join(want, F.col("path") == F.col("_path"), "left")
        other = ~(F.col("_bytes").eqNullSafe(F.col("byte_count")) & F.col("_sha256").eqNullSafe(F.sha2("content", 256)))
    error = F.when(F.col("byte_count") > most_bytes, "TEXT_TOO_LARGE").when(other, "ARTIFACT_INTEGRITY_FAILED").when(~F.is_valid_utf8(F.col("content").cast("string")), "TEXT_INVALID_UTF8")
    return rows.select("path", F.when(error.isNull(), F.col("content").cast("string")).alias("text"), "byte_count", error.alias("error_code"))


def verify(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """artifacts (id, relative_path, byte_count, sha256, ...) with status: verified, missing or mismatch, by the files (path, byte_count, sha256) that are there."""
    there = files.select(F.col("path").alias("_path"), F.col("byte_count").alias("_bytes"), F.col("sha256").alias("_sha256"))
    both = artifacts.join(there, F.col("relative_path") == F.col("_path"), "left")
    same = (F.col("byte_count") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha256"))
    return both.withColumn("status", F.when(F.col("_path").isNull(), "missing").when(same, "verified").otherwise("mismatch")).drop("_path", "_bytes", "_sha256")


def publish(artifacts: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh (relative_path, byte_count, sha256) with created and error_code as their publication into artifacts ends.

    A path that is there with the same bytes is not created again; with others it is STORAGE_ARTIFACT_IMMUTABLE, an
    unsafe path SCHEMA_INVALID. Of several with one path the first by hash is published, others conflict with it.
    """
    known = artifacts.groupBy(F.col("relative_path").alias("_path")).agg(F.min("sha256").alias("_sha256"), F.min("byte_count").alias("_bytes"))
    first = fresh.groupBy(F.col("relative_path").alias("_own")).agg(F.min("sha256").alias("_first"))
    both = fresh.join(known, F.col("relative_path") == F.col("_path"), "left").join(first, F.col("relative_path") == F.col("_own"), "left")
    other = F.when(F.col("_path").isNotNull(), (F.col("_sha256") != F.col("sha256")) | (F.col("_bytes") != F.col("byte_count"))).otherwise(F.col("_first") != F.col("sha256"))
    error = F.when(~is_safe_path(F.col("relative_path")), "SCHEMA_INVALID").when(other, "STORAGE_ARTIFACT_IMMUTABLE")
    return both.select(*fresh.columns, (error.isNull() & F.col("_path").isNull()).alias("created"), error.alias("error_code"))


def usage(files: DataFrame) -> DataFrame:
    """One row: files and bytes of the store, and of those in quarantine."""
    away = F.col("path").startswith("Quarantine/")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("byte_count"))), F.lit(0)).cast("long")
    return files.agg(F.count_if(~away).alias("artifact_count"), total(~away).alias("artifact_bytes"), F.count_if(away).alias("quarantine_count"), total(away).alias("quarantine_bytes"))


def divergence(stored: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the counts and bytes that the metadata and the store have, and whether they differ."""
    a = stored.agg(F.count("*").alias("known_count"), F.coalesce(F.sum("byte_count"), F.lit(0)).cast("long").alias("known_bytes"))
    both = a.crossJoin(F.broadcast(usage(files)))  # a row each
    return both.select("known_count", "known_bytes", "artifact_count", "artifact_bytes", ((F.col("known_count") != F.col("artifact_count")) | (F.col("known_bytes") != F.col("artifact_bytes"))).alias("diverged"))


def cleanup(files: DataFrame, artifacts: DataFrame, references: DataFrame, now_ms: int, recovering: DataFrame | None = None) -> DataFrame:
    """files (path, modified_ms) to path, action: keep, delete, quarantine or purge.

    Files of no artifact go to quarantine and such of unreferenced artifacts are deleted, both a day old at least and not
    of a pack that is recovering (column pack_id: the second part of the path). Files in quarantine are purged after
    seven days.
    """
    used = references.select(F.col("artifact_id").alias("r")).distinct()
    known = artifacts.select(F.col("id").alias("a"), F.col("relative_path").alias("p")).join(used, F.col("a") == F.col("r"), "left").groupBy("p").agg(F.max(F.col("r").isNotNull()).alias("used"))
    rows = files.join(known, F.col("path") == F.col("p"), "left")
    spared = F.lit(False)
    if recovering is not None:
        busy = recovering.select(F.col("pack_id").cast("string").alias("busy")).distinct()
        rows = rows.withColumn("pack", F.get(F.split("path", "/"), 1)).join(busy, F.col("pack") == F.col("busy"), "left")
        spared = F.col("busy").isNotNull()
    old = lambda ms: F.col("modified_ms") <= now_ms - ms
    away = F.col("path").startswith("Quarantine/")
    action = F.when(away, F.when(old(PURGE_MS), "purge").otherwise("keep")).when(spared | ~old(DAY_MS), "keep")
    action = action.when(F.col("p").isNull(), "quarantine").when(~F.col("used"), "delete").otherwise("keep")
    return rows.select("path", action.alias("action"))
