"""Lookups and state-changing statements over the tables of a document library, each as the rows that it reads or leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators import dedup, files, pages, privacy
from quirework.operators import tables as K
from quirework.plans.relational import CUTOFF, NOW
from quirework.plans.relational import query as query
from quirework.streaming import events as E

#: A moment that some of the changes below are made at, between those of the tables.
LATER = "1996-06-01T00:00:00Z"


# Lookups.


@query(
    """SELECT o.import_id, CASE WHEN i.import_id IS NULL THEN 'created' WHEN i.status = o.status AND i.pack_id = o.pack_id THEN 'replayed' ELSE 'conflict' END AS outcome
       FROM (SELECT import_id + CASE WHEN source LIKE '1%' THEN 100000000 ELSE 0 END AS import_id, pack_id, CASE WHEN source LIKE '2%' THEN 'failed' ELSE status END AS status FROM imports) o LEFT JOIN imports i ON i.import_id = o.import_id""",
    "imports",
)
def import_replays(imports: DataFrame) -> DataFrame:
    """Imports that come again, some under a new id or with another status: replayed, created, or in conflict with what is there."""
    again = imports.select((F.col("import_id") + F.when(F.col("source").like("1%"), 100_000_000).otherwise(0)).alias("o_id"), F.col("pack_id").alias("o_pack"), F.when(F.col("source").like("2%"), "failed").otherwise(F.col("status")).alias("o_status"))
    both = again.join(imports, F.col("o_id") == F.col("import_id"), "left")
    outcome = F.when(F.col("import_id").isNull(), "created").when((F.col("status") == F.col("o_status")) & (F.col("pack_id") == F.col("o_pack")), "replayed").otherwise("conflict")
    return both.select(F.col("o_id").alias("import_id"), outcome.alias("outcome"))


@query("SELECT i.import_id, j.phase, j.updated_at, j.error_code FROM imports i LEFT JOIN journal j ON j.ingestion_id = i.import_id AND j.phase <> 'quarantined'", "imports", "journal")
def journal_entries(imports: DataFrame, journal: DataFrame) -> DataFrame:
    live = journal.filter("phase <> 'quarantined'").select("ingestion_id", "phase", "updated_at", "error_code")
    return imports.join(live, F.col("import_id") == F.col("ingestion_id"), "left").select("import_id", "phase", "updated_at", "error_code")


@query("SELECT j.ingestion_id, r.id AS run_id, r.status IN ('failed', 'succeeded') AS ended FROM journal j JOIN run_items r ON r.import_id = j.ingestion_id", "journal", "run_items")
def run_statuses(journal: DataFrame, runs: DataFrame) -> DataFrame:
    return journal.join(runs, F.col("ingestion_id") == F.col("import_id")).select("ingestion_id", F.col("id").alias("run_id"), F.col("status").isin("failed", "succeeded").alias("ended"))


@query("SELECT f.id, EXISTS (SELECT 1 FROM context_items c JOIN packs p ON p.id = c.pack_id WHERE c.id = f.item_id AND p.deleted_at IS NULL) AS live FROM risk_findings f", "risk_findings", "context_items", "packs")
def live_findings(findings: DataFrame, library: DataFrame, packs: DataFrame) -> DataFrame:
    live = library.join(packs.filter("deleted_at is null").select(F.col("id").alias("p")), F.col("pack_id") == F.col("p"), "left_semi").select(F.col("id").alias("c")).distinct()
    return findings.select("id", "item_id").join(live, F.col("item_id") == F.col("c"), "left").select("id", F.col("c").isNotNull().alias("live"))


@query("SELECT item_id, id, category, row_number() OVER (PARTITION BY item_id ORDER BY created_at, id, category, severity) AS place FROM risk_findings", "risk_findings")
def item_findings(findings: DataFrame) -> DataFrame:
    return findings.select("item_id", "id", "category", F.row_number().over(Window.partitionBy("item_id").orderBy("created_at", "id", "category", "severity")).cast("long").alias("place"))


@query(
    """SELECT e.pack_id, e.id, row_number() OVER (PARTITION BY e.pack_id ORDER BY e.created_at, e.id) AS place, e.format,
         (SELECT string_agg(a.artifact_id, ',' ORDER BY a.sort_index, a.artifact_id) FROM export_artifacts a WHERE a.export_id = e.id) AS artifacts FROM export_records e""",
    "export_records", "export_artifacts",
)
def pack_exports(exports: DataFrame, parts: DataFrame) -> DataFrame:
    own = parts.groupBy(F.col("export_id").alias("e")).agg(F.array_sort(F.collect_list(F.struct("sort_index", "artifact_id"))).alias("a"))
    rows = exports.join(own, F.col("id") == F.col("e"), "left")
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("created_at", "id")).cast("long")
    return rows.select("pack_id", "id", place.alias("place"), "format", F.array_join(F.transform("a", lambda x: x["artifact_id"]), ",").alias("artifacts"))


@query("SELECT id, created_at, row_number() OVER (ORDER BY created_at, id, relative_path) AS place FROM artifacts", "artifacts")
def artifacts_ordered(artifacts: DataFrame) -> DataFrame:
    return K.placed(artifacts.select("id", "created_at", "relative_path"), "created_at", "id", "relative_path").select("id", "created_at", "place")


@query(
    """SELECT a.id, a.kind, c.state, a.sha256 = c.original_sha256 AS same_hash, a.byte_count = c.byte_count AS same_size FROM artifacts a JOIN context_items c ON c.id = a.item_id WHERE a.kind = 'original'""",
    "artifacts", "context_items",
)
def original_integrity(artifacts: DataFrame, library: DataFrame) -> DataFrame:
    own = library.select(F.col("id").alias("c"), "state", "original_sha256", F.col("byte_count").alias("own_bytes"))
    return artifacts.filter("kind = 'original'").join(own, F.col("item_id") == F.col("c")).select("id", "kind", "state", (F.col("sha256") == F.col("original_sha256")).alias("same_hash"), (F.col("byte_count") == F.col("own_bytes")).alias("same_size"))


@query("SELECT c.id, c.inclusion_mode FROM context_items c WHERE EXISTS (SELECT 1 FROM stored_suggestions s WHERE s.pack_id = c.pack_id AND (s.left_id = c.id OR s.right_id = c.id))", "context_items", "stored_suggestions")
def suggested_items(library: DataFrame, stored: DataFrame) -> DataFrame:
    """Both ends as rows, so that one equi-join does."""
    ends = stored.select(F.col("pack_id").alias("p"), F.explode(F.array("left_id", "right_id")).alias("end")).distinct()
    return library.join(ends, (F.col("pack_id") == F.col("p")) & (F.col("id") == F.col("end")), "left_semi").select("id", "inclusion_mode")


@query("SELECT event_id AS id, event_type AS code, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events WHERE event_type = 'error'", "events")
def diagnostics_newest(events: DataFrame) -> DataFrame:
    rows = events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("event_type").alias("code"), "ts")
    return K.placed(rows, F.desc("ts"), "id").select("id", "code", "place")


@query("SELECT DISTINCT pack_id FROM journal WHERE phase <> 'quarantined'", "journal")
def recovering_packs(journal: DataFrame) -> DataFrame:
    return journal.filter("phase <> 'quarantined'").select("pack_id").distinct()


@query(
    """SELECT r.owner_id, r.artifact_id, CASE WHEN a.id IS NULL THEN 'no-artifact' WHEN c.id IS NULL THEN 'no-item' WHEN a.item_id <> c.id THEN 'other-item' ELSE 'ok' END AS verdict
       FROM artifact_references r LEFT JOIN (SELECT DISTINCT id, item_id FROM artifacts) a ON a.id = r.artifact_id LEFT JOIN (SELECT DISTINCT id FROM context_items) c ON c.id = r.owner_id WHERE r.owner_type = 'context-item'""",
    "artifact_references", "artifacts", "context_items",
)
def reference_checks(references: DataFrame, artifacts: DataFrame, library: DataFrame) -> DataFrame:
    a = artifacts.select(F.col("id").alias("a"), F.col("item_id").alias("a_item")).distinct()
    c = library.select(F.col("id").alias("c")).distinct()
    rows = references.filter("owner_type = 'context-item'").join(a, F.col("artifact_id") == F.col("a"), "left").join(c, F.col("owner_id") == F.col("c"), "left")
    verdict = F.when(F.col("a").isNull(), "no-artifact").when(F.col("c").isNull(), "no-item").when(F.col("a_item") != F.col("c"), "other-item").otherwise("ok")
    return rows.select("owner_id", "artifact_id", verdict.alias("verdict"))


@query("SELECT c.id, c.pack_id, n.id AS normalized_id, n.byte_count FROM context_items c LEFT JOIN artifacts n ON n.item_id = c.id AND n.kind = 'normalized-text' WHERE c.state IN ('extracted', 'analyzed')", "context_items", "artifacts")
def analysis_refresh(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    own = artifacts.filter("kind = 'normalized-text'").select(F.col("id").alias("normalized_id"), F.col("item_id").alias("i"), F.col("byte_count").alias("n_bytes"))
    rows = library.filter(F.col("state").isin("extracted", "analyzed")).join(own, F.col("id") == F.col("i"), "left")
    return rows.select("id", "pack_id", "normalized_id", F.col("n_bytes").alias("byte_count"))


@query("SELECT i.import_id, a.id, a.item_id, a.relative_path, a.byte_count, a.sha256 FROM import_items i JOIN artifacts a ON a.item_id = i.item_id AND a.kind = 'original'", "import_items", "artifacts")
def import_artifacts(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    own = items.select("import_id", F.col("item_id").alias("i"))
    return artifacts.filter("kind = 'original'").join(own, F.col("item_id") == F.col("i")).select("import_id", "id", "item_id", "relative_path", "byte_count", "sha256")


@query(
    """SELECT c.id, d.choice, d.baseline, c.inclusion_mode = CASE WHEN d.choice = 'exclude' THEN 'excluded' ELSE d.baseline END AS consistent, EXISTS (SELECT 1 FROM import_items i JOIN imports m ON m.import_id = i.import_id WHERE i.item_id = c.id AND m.pack_id = c.pack_id) AS owned
       FROM context_items c LEFT JOIN decisions d ON d.item_id = c.id""",
    "context_items", "decisions", "import_items", "imports",
)
def decision_priors(library: DataFrame, decisions: DataFrame, items: DataFrame, imports: DataFrame) -> DataFrame:
    made = decisions.select(F.col("item_id").alias("d"), "choice", "baseline")
    own = items.select("import_id", F.col("item_id").alias("i")).join(imports.select("import_id", F.col("pack_id").alias("m_pack")), "import_id").select("i", "m_pack").distinct()
    rows = library.join(made, F.col("id") == F.col("d"), "left").join(own, (F.col("id") == F.col("i")) & (F.col("pack_id") == F.col("m_pack")), "left")
    mode = F.when(F.col("choice") == "exclude", "excluded").otherwise(F.col("baseline"))
    return rows.select("id", "choice", "baseline", (F.col("inclusion_mode") == mode).alias("consistent"), F.col("i").isNotNull().alias("owned"))


@query("SELECT c.id, c.pack_id, coalesce(d.choice, 'keep') AS choice, row_number() OVER (PARTITION BY c.pack_id ORDER BY c.import_id, c.sort_index, c.id, coalesce(d.choice, 'keep'), d.baseline NULLS FIRST) AS place FROM context_items c LEFT JOIN decisions d ON d.item_id = c.id AND d.pack_id = c.pack_id", "context_items", "decisions")
def decided_items(library: DataFrame, decisions: DataFrame) -> DataFrame:
    made = decisions.select(F.col("item_id").alias("d"), F.col("pack_id").alias("d_pack"), "choice", "baseline")
    rows = library.join(made, (F.col("id") == F.col("d")) & (F.col("pack_id") == F.col("d_pack")), "left").withColumn("choice", F.coalesce("choice", F.lit("keep")))
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("import_id", "sort_index", "id", "choice", F.col("baseline").asc_nulls_first())).cast("long")
    return rows.select("id", "pack_id", "choice", place.alias("place"))


@query(
    """SELECT p.id, p.revision, (SELECT count(*) FROM context_items c WHERE c.pack_id = p.id) AS items, (SELECT string_agg(CAST(e.id AS VARCHAR), ',' ORDER BY e.created_at, e.id) FROM export_records e WHERE e.pack_id = p.id) AS exports
       FROM packs p WHERE p.deleted_at IS NULL""",
    "packs", "context_items", "export_records",
)
def pack_graph_exports(packs: DataFrame, library: DataFrame, exports: DataFrame) -> DataFrame:
    items = library.groupBy(F.col("pack_id").alias("c")).agg(F.count("*").alias("items"))
    own = exports.groupBy(F.col("pack_id").alias("e")).agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("x"))
    rows = packs.filter("deleted_at is null").join(items, F.col("id") == F.col("c"), "left").join(own, F.col("id") == F.col("e"), "left")
    return rows.select("id", "revision", F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.array_join(F.transform("x", lambda r: r["id"].cast("string")), ",").alias("exports"))


@query(
    """SELECT a.id, a.item_id, a.byte_count, c.source_type, (SELECT count(*) FROM artifacts o WHERE o.item_id = a.item_id AND o.kind = 'original') AS originals,
         (SELECT arg_min(o.sha256, o.id) FROM artifacts o WHERE o.item_id = a.item_id AND o.kind = 'original') AS original_sha256, (SELECT arg_min(o.byte_count, o.id) FROM artifacts o WHERE o.item_id = a.item_id AND o.kind = 'original') AS original_bytes
       FROM artifacts a LEFT JOIN (SELECT DISTINCT id, source_type FROM context_items) c ON c.id = a.item_id WHERE a.kind = 'normalized-text'""",
    "artifacts", "context_items",
)
def stored_analyses(artifacts: DataFrame, library: DataFrame) -> DataFrame:
    """The three lookups of a record's original are one aggregate and one join."""
    own = artifacts.filter("kind = 'original'").groupBy(F.col("item_id").alias("o")).agg(F.count("*").alias("n"), F.min_by(F.struct("sha256", "byte_count"), "id").alias("first"))
    items = library.select(F.col("id").alias("c"), "source_type").distinct()
    rows = artifacts.filter("kind = 'normalized-text'").join(items, F.col("item_id") == F.col("c"), "left").join(own, F.col("item_id") == F.col("o"), "left")
    return rows.select("id", "item_id", "byte_count", "source_type", F.coalesce("n", F.lit(0)).cast("long").alias("originals"), F.col("first.sha256").alias("original_sha256"), F.col("first.byte_count").alias("original_bytes"))


@query("SELECT pack_id, 'similar-text:' || left_id || ':' || right_id AS key, row_number() OVER (PARTITION BY pack_id ORDER BY left_id, right_id, group_id) AS place FROM stored_suggestions", "stored_suggestions")
def suggestions_ordered(stored: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("left_id", "right_id", "group_id")).cast("long")
    return stored.select("pack_id", F.concat_ws(":", F.lit("similar-text"), "left_id", "right_id").alias("key"), place.alias("place"))


@query(
    """SELECT r.id, r.status, p.deleted_at IS NULL AND c.import_id IS NOT NULL AS live FROM run_items r JOIN packs p ON p.id = r.pack_id LEFT JOIN (SELECT DISTINCT import_id FROM context_items) c ON c.import_id = r.import_id""",
    "run_items", "packs", "context_items",
)
def run_liveness(runs: DataFrame, packs: DataFrame, library: DataFrame) -> DataFrame:
    own = library.select(F.col("import_id").alias("c")).distinct()
    rows = runs.join(packs.select(F.col("id").alias("p"), "deleted_at"), F.col("pack_id") == F.col("p")).join(own, F.col("import_id") == F.col("c"), "left")
    return rows.select("id", "status", (F.col("deleted_at").isNull() & F.col("c").isNotNull()).alias("live"))


@query("SELECT r.id, c.id AS item_id, c.state, p.revision FROM run_items r JOIN packs p ON p.id = r.pack_id JOIN context_items c ON c.import_id = r.import_id WHERE p.deleted_at IS NULL AND r.status = 'running'", "run_items", "packs", "context_items")
def settlement_items(runs: DataFrame, packs: DataFrame, library: DataFrame) -> DataFrame:
    live = packs.filter("deleted_at is null").select(F.col("id").alias("p"), "revision")
    own = library.select(F.col("id").alias("item_id"), F.col("import_id").alias("of"), "state")
    return runs.filter("status = 'running'").join(live, F.col("pack_id") == F.col("p")).join(own, F.col("import_id") == F.col("of")).select("id", "item_id", "state", "revision")


@query("SELECT pack_id, max(updated_at) AS latest, arg_max(id, updated_at || lpad(CAST(id AS VARCHAR), 12, '0')) AS latest_run FROM run_items GROUP BY pack_id", "run_items")
def latest_sibling(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pack_id").agg(F.max("updated_at").alias("latest"), F.max_by("id", F.struct("updated_at", "id")).alias("latest_run"))


# Aggregates.


@query(
    """SELECT import_id, count(*) AS items, string_agg(t || '=' || n, ',' ORDER BY first) AS types, CASE WHEN bool_and(t IN ('text/plain', 'text/uri-list')) THEN 'main-app-text' ELSE 'main-app-picker' END AS source, CAST(sum(bytes) AS BIGINT) AS bytes
       FROM (SELECT import_id, lower(media_type) AS t, count(*) AS n, min(lpad(CAST(sort_index AS VARCHAR), 12, '0') || item_id) AS first, sum(byte_count) AS bytes FROM import_items GROUP BY 1, 2) GROUP BY import_id""",
    "import_items",
)
def import_type_counts(items: DataFrame) -> DataFrame:
    """Kinds of an import in the order in which they are first seen; items counts the kinds."""
    t = F.lower("media_type")
    own = items.groupBy("import_id", t.alias("t")).agg(F.count("*").alias("n"), F.min(F.struct("sort_index", "item_id")).alias("first"), F.sum("byte_count").alias("bytes"))
    rows = own.groupBy("import_id").agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("first", "t", "n"))).alias("k"), F.bool_and(F.col("t").isin("text/plain", "text/uri-list")).alias("typed"), F.sum("bytes").alias("bytes"))
    types = F.array_join(F.transform("k", lambda x: F.concat(x["t"], F.lit("="), x["n"].cast("string"))), ",")
    return rows.select("import_id", "items", types.alias("types"), F.when(F.col("typed"), "main-app-text").otherwise("main-app-picker").alias("source"), F.col("bytes").cast("long").alias("bytes"))


@query(
    """SELECT c.pack_id, count(*) AS items, (SELECT count(*) FROM stored_suggestions s WHERE s.pack_id = c.pack_id) AS suggestions, max(c.created_at) AS analyzed_at FROM context_items c GROUP BY c.pack_id""",
    "context_items", "stored_suggestions",
)
def analysis_manifests(library: DataFrame, stored: DataFrame) -> DataFrame:
    edges = stored.groupBy(F.col("pack_id").alias("s")).agg(F.count("*").alias("n"))
    own = library.groupBy("pack_id").agg(F.count("*").alias("items"), F.max("created_at").alias("analyzed_at"))
    return own.join(edges, F.col("pack_id") == F.col("s"), "left").select("pack_id", "items", F.coalesce("n", F.lit(0)).cast("long").alias("suggestions"), "analyzed_at")


@query(
    """SELECT CAST(count(*) FILTER (WHERE l AND r) AS DOUBLE) / nullif(count(*) FILTER (WHERE l), 0) AS precision, CAST(count(*) FILTER (WHERE l AND r) AS DOUBLE) / nullif(count(*) FILTER (WHERE r), 0) AS recall
       FROM (SELECT s.bytes_saved > 20000 AS l, a.sha256 = b.sha256 AS r FROM stored_suggestions s JOIN (SELECT item_id, min(sha256) AS sha256 FROM artifacts WHERE kind = 'original' GROUP BY item_id) a ON a.item_id = s.left_id JOIN (SELECT item_id, min(sha256) AS sha256 FROM artifacts WHERE kind = 'original' GROUP BY item_id) b ON b.item_id = s.right_id)""",
    "stored_suggestions", "artifacts",
)
def detector_quality(stored: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Precision and recall of suggestions over 20 kB, were equal hashes the truth."""
    own = artifacts.filter("kind = 'original'").groupBy("item_id").agg(F.min("sha256").alias("sha256"))
    pairs = stored.join(own.toDF("a", "a_sha"), F.col("left_id") == F.col("a")).join(own.toDF("b", "b_sha"), F.col("right_id") == F.col("b"))
    return dedup.precision_recall(pairs.select((F.col("bytes_saved") > 20_000).alias("found"), (F.col("a_sha") == F.col("b_sha")).alias("true")))


@query(
    """SELECT (SELECT count(*) FROM file_artifacts) AS known_count, (SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM file_artifacts) AS known_bytes, count(*) FILTER (WHERE path LIKE 'Packs/%') AS artifact_count, CAST(coalesce(sum(strlen(content)) FILTER (WHERE path LIKE 'Packs/%'), 0) AS BIGINT) AS artifact_bytes,
         (SELECT count(*) FROM file_artifacts) <> count(*) FILTER (WHERE path LIKE 'Packs/%') OR (SELECT coalesce(sum(strlen(text)), 0) FROM file_artifacts) <> coalesce(sum(strlen(content)) FILTER (WHERE path LIKE 'Packs/%'), 0) AS diverged FROM file_store""",
    "file_artifacts", "file_store",
)
def storage_divergence(artifacts: DataFrame, store: DataFrame) -> DataFrame:
    return files.divergence(artifacts.select(F.octet_length("text").cast("long").alias("byte_count")), store.select("path", F.octet_length("content").cast("long").alias("byte_count")))


@query(
    """SELECT a.kind, CASE WHEN f.path IS NULL THEN 'missing' WHEN sha256(f.content) = sha256(a.text) THEN 'verified' ELSE 'mismatch' END AS status, count(*) AS artifacts
       FROM file_artifacts a LEFT JOIN file_store f ON f.path = a.relative_path GROUP BY 1, 2""",
    "file_artifacts", "file_store",
)
def integrity_audit(artifacts: DataFrame, store: DataFrame) -> DataFrame:
    """Documents as artifacts, against a store that lost some and changed others."""
    known = artifacts.select("id", "kind", "relative_path", F.octet_length("text").cast("long").alias("byte_count"), F.sha2("text", 256).alias("sha256"))
    there = store.select("path", F.octet_length("content").cast("long").alias("byte_count"), F.sha2("content", 256).alias("sha256"))
    return files.verify(known, there).groupBy("kind", "status").agg(F.count("*").alias("artifacts"))


@query(
    """SELECT a.relative_path, CASE WHEN f.path IS NULL THEN true ELSE false END AS created, CASE WHEN f.content <> a.text THEN 'STORAGE_ARTIFACT_IMMUTABLE' END AS error_code FROM file_artifacts a LEFT JOIN file_store f ON f.path = a.relative_path""",
    "file_artifacts", "file_store",
)
def artifact_publication(artifacts: DataFrame, store: DataFrame) -> DataFrame:
    """Every artifact published once more: those that the store lost are created, changed ones can't be replaced."""
    fresh = artifacts.select("relative_path", F.octet_length("text").cast("long").alias("byte_count"), F.sha2("text", 256).alias("sha256"))
    known = store.select(F.col("path").alias("relative_path"), F.octet_length("content").cast("long").alias("byte_count"), F.sha2("content", 256).alias("sha256"))
    return files.publish(known, fresh).select("relative_path", "created", "error_code")


# Changes.


@query(
    """SELECT r.owner_type, r.owner_id, r.artifact_id FROM artifact_references r
       UNION ALL SELECT DISTINCT 'library-item', a.item_id, a.id FROM artifacts a WHERE a.kind = 'original'
       UNION ALL SELECT DISTINCT 'context-item', a.item_id, a.id FROM artifacts a WHERE a.kind = 'original' AND NOT EXISTS (SELECT 1 FROM artifact_references r WHERE r.owner_type = 'context-item' AND r.owner_id = a.item_id AND r.artifact_id = a.id)""",
    "artifact_references", "artifacts",
)
def insert_references(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References of both kinds to all originals, those ignored that are there."""
    own = artifacts.filter("kind = 'original'").select(F.explode(F.array(F.lit("library-item"), F.lit("context-item"))).alias("owner_type"), F.col("item_id").alias("owner_id"), F.col("id").alias("artifact_id"))
    return K.insert_or_ignore(references, own, "owner_type", "owner_id", "artifact_id")


@query(
    """SELECT 'imports' AS target, count(*) AS added, CAST(0 AS BIGINT) AS bytes FROM imports WHERE status <> 'failed'
       UNION ALL SELECT 'import_items', count(*), CAST(coalesce(sum(i.byte_count), 0) AS BIGINT) FROM import_items i JOIN imports m ON m.import_id = i.import_id AND m.status <> 'failed'
       UNION ALL SELECT 'context_items', count(*), CAST(coalesce(sum(i.byte_count), 0) AS BIGINT) FROM import_items i JOIN imports m ON m.import_id = i.import_id AND m.status <> 'failed' AND i.status = 'copied'
       UNION ALL SELECT 'artifacts', count(*), CAST(coalesce(sum(i.byte_count), 0) AS BIGINT) FROM import_items i JOIN imports m ON m.import_id = i.import_id AND m.status <> 'failed' AND i.status = 'copied'
       UNION ALL SELECT 'artifact_references', count(*), CAST(0 AS BIGINT) FROM import_items i JOIN imports m ON m.import_id = i.import_id AND m.status <> 'failed' AND i.status = 'copied'""",
    "imports", "import_items",
)
def commit_rows(imports: DataFrame, items: DataFrame) -> DataFrame:
    """What the five tables get from the manifests that are committed: each manifest's items are exploded once."""
    live = imports.filter("status <> 'failed'").select(F.col("import_id").alias("m"))
    own = items.join(live, F.col("import_id") == F.col("m"))
    copied = F.col("status") == "copied"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("byte_count"))), F.lit(0)).cast("long")
    counts = own.agg(F.count("*").alias("n"), total(F.lit(True)).alias("b"), F.count_if(copied).alias("cn"), total(copied).alias("cb"))
    zero = F.lit(0).cast("long")
    rows = [("import_items", "n", F.col("b")), ("context_items", "cn", F.col("cb")), ("artifacts", "cn", F.col("cb")), ("artifact_references", "cn", zero)]
    parts = counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(n).alias("added"), b.alias("bytes")) for t, n, b in rows])))
    return live.agg(F.count("*").alias("added")).select(F.lit("imports").alias("target"), "added", zero.alias("bytes")).unionByName(parts)


@query(
    f"""SELECT ingestion_id, pack_id, CASE WHEN phase IN ('discovered', 'handoff-started') THEN 'files-published' ELSE phase END AS phase, CASE WHEN phase IN ('discovered', 'handoff-started') THEN '{LATER}' ELSE updated_at END AS updated_at,
          CASE WHEN phase IN ('discovered', 'handoff-started') THEN NULL ELSE error_code END AS error_code FROM journal
        UNION ALL SELECT ingestion_id + 100000000, pack_id, 'discovered', '{LATER}', NULL FROM journal WHERE phase = 'database-committed'""",
    "journal",
)
def journal_upsert(journal: DataFrame) -> DataFrame:
    """Entries that started are published, after an older change that the newer one replaces; new ones begin."""
    started = journal.filter(F.col("phase").isin("discovered", "handoff-started"))
    changes = started.select("ingestion_id", "pack_id", F.lit("handoff-started").alias("phase"), F.lit("1990-01-01T00:00:00Z").alias("updated_at"), F.lit("X").alias("error_code"))
    changes = changes.unionByName(started.select("ingestion_id", "pack_id", F.lit("files-published").alias("phase"), F.lit(LATER).alias("updated_at"), F.lit(None).cast("string").alias("error_code")))
    fresh = journal.filter("phase = 'database-committed'").select((F.col("ingestion_id") + 100_000_000).alias("ingestion_id"), "pack_id", F.lit("discovered").alias("phase"), F.lit(LATER).alias("updated_at"), F.lit(None).cast("string").alias("error_code"))
    return K.upsert(journal, changes.unionByName(fresh), "ingestion_id", ("pack_id", "phase", "updated_at", "error_code"), "updated_at")


@query(
    f"""SELECT id, CASE WHEN ok THEN 'T' || title ELSE title END AS title, CASE WHEN ok THEN 'processing' ELSE state END AS state, CASE WHEN ok THEN '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN ok THEN revision + 1 ELSE revision END AS revision,
          CASE WHEN id IN (SELECT max(id) FROM packs) THEN 'kept' WHEN ok THEN 'updated' ELSE 'conflict' END AS outcome
        FROM (SELECT *, id NOT IN (SELECT max(id) FROM packs) AND deleted_at IS NULL AND revision = warnings % 3 AS ok FROM packs)
        UNION ALL SELECT id + 1000000, 'T' || title, 'processing', '{NOW}', 1, 'inserted' FROM packs WHERE warnings = 3
        UNION ALL SELECT id + 2000000, NULL, NULL, NULL, NULL, 'conflict' FROM packs WHERE warnings = 2""",
    "packs",
)
def packs_saved(packs: DataFrame) -> DataFrame:
    """All packs but the last are saved, at the revision that each is thought to have; some are new, and some expect a revision of nothing."""
    change = lambda rows, shift, expected: rows.select((F.col("id") + shift).alias("id"), expected.cast("long").alias("expected"), F.concat(F.lit("T"), "title").alias("title"), F.lit("processing").alias("state"), F.lit(NOW).alias("updated_at"))
    last = packs.agg(F.max("id")).first()[0]
    changes = change(packs.filter(F.col("id") != F.lit(last)), 0, F.col("warnings") % 3).unionByName(change(packs.filter("warnings = 3"), 1_000_000, F.lit(None)))
    changes = changes.unionByName(change(packs.filter("warnings = 2"), 2_000_000, F.lit(7)))
    return K.compare_and_set(packs, changes, "id", "revision", ("title", "state", "updated_at"), F.col("deleted_at").isNull()).select("id", "title", "state", "updated_at", "revision", "outcome")


@query(
    """SELECT id, pack_id, CASE WHEN state = 'received' THEN 'imported' ELSE state END AS state, inclusion_mode, CASE WHEN state = 'received' THEN sort_index + 10 ELSE sort_index END AS sort_index, created_at FROM context_items
       UNION ALL SELECT id || '/new', pack_id, 'received', inclusion_mode, sort_index, created_at FROM (SELECT DISTINCT id, pack_id, inclusion_mode, sort_index, created_at FROM context_items WHERE state = 'packaged')""",
    "context_items",
)
def items_upsert(library: DataFrame) -> DataFrame:
    table = library.select("id", "pack_id", "state", "inclusion_mode", "sort_index", "created_at")
    moved = table.filter("state = 'received'").select("id", "pack_id", F.lit("imported").alias("state"), "inclusion_mode", (F.col("sort_index") + 10).alias("sort_index"), F.lit("never").alias("created_at"))
    fresh = table.filter("state = 'packaged'").select(F.concat("id", F.lit("/new")).alias("id"), "pack_id", F.lit("received").alias("state"), "inclusion_mode", "sort_index", "created_at")
    # The pack of an item and when it was made never change.
    return K.upsert(table, moved.unionByName(fresh), "id", ("state", "inclusion_mode", "sort_index"), "sort_index")


@query(
    f"""SELECT id, item_id, CASE WHEN severity = 'high' THEN 'jwt' ELSE category END AS category, CASE WHEN severity = 'high' THEN 'low' ELSE severity END AS severity, CASE WHEN severity = 'high' THEN 1.0 ELSE confidence END AS confidence, CASE WHEN severity = 'high' THEN '{LATER}' ELSE created_at END AS created_at FROM risk_findings
        UNION ALL SELECT id || '2', item_id, category, severity, 0.5, created_at FROM (SELECT DISTINCT * FROM risk_findings WHERE category = 'phone')""",
    "risk_findings",
)
def findings_upsert(findings: DataFrame) -> DataFrame:
    again = findings.filter("severity = 'high'").select("id", "item_id", F.lit("jwt").alias("category"), F.lit("low").alias("severity"), F.lit(1.0).alias("confidence"), F.lit(LATER).alias("created_at"))
    fresh = findings.filter("category = 'phone'").select(F.concat("id", F.lit("2")).alias("id"), "item_id", "category", "severity", F.lit(0.5).alias("confidence"), "created_at")
    return K.upsert(findings, again.unionByName(fresh), "id", ("category", "severity", "confidence", "created_at"), "created_at")


@query(
    """SELECT a.export_id, a.artifact_id, a.sort_index FROM export_artifacts a WHERE a.export_id NOT IN (SELECT id FROM export_records WHERE format = 'pdf')
       UNION ALL SELECT export_id, artifact_id, row_number() OVER (PARTITION BY export_id ORDER BY sort_index DESC, artifact_id) - 1 FROM export_artifacts WHERE export_id IN (SELECT id FROM export_records WHERE format = 'pdf')""",
    "export_artifacts", "export_records",
)
def exports_saved(parts: DataFrame, exports: DataFrame) -> DataFrame:
    """Exports of one format are saved again with their artifacts the other way round: children are deleted and inserted."""
    saved = exports.filter("format = 'pdf'").select(F.col("id").alias("export_id"))
    place = F.row_number().over(Window.partitionBy("export_id").orderBy(F.desc("sort_index"), "artifact_id")) - 1
    fresh = parts.join(saved, "export_id", "left_semi").select("export_id", "artifact_id", place.cast("long").alias("sort_index"))
    return K.replace_children(parts, fresh, saved, "export_id")


@query(
    """SELECT pack_id, left_id, right_id FROM stored_suggestions WHERE pack_id NOT IN (SELECT id FROM packs WHERE warnings = 1)
       UNION ALL SELECT pack_id, left_id, right_id FROM stored_suggestions WHERE bytes_saved > 25000 AND pack_id IN (SELECT id FROM packs WHERE warnings = 1)""",
    "stored_suggestions", "packs",
)
def suggestions_replaced(stored: DataFrame, packs: DataFrame) -> DataFrame:
    """Some packs are analysed anew: what they had goes, and only larger suggestions come again."""
    table, anew = stored.select("pack_id", "left_id", "right_id"), packs.filter("warnings = 1").select(F.col("id").alias("pack_id"))
    fresh = stored.filter("bytes_saved > 25000").join(anew, "pack_id", "left_semi").select("pack_id", "left_id", "right_id")
    return K.replace_children(table, fresh, anew, "pack_id")


@query(
    """SELECT c.id, c.pack_id, coalesce(CASE WHEN d.choice = 'exclude' THEN 'excluded' ELSE d.baseline END, c.inclusion_mode) AS inclusion_mode, CASE WHEN d.decided_at > c.created_at THEN d.decided_at ELSE c.created_at END AS updated_at,
         p.revision + (SELECT count(*) > 0 FROM decisions x WHERE x.pack_id = p.id)::BIGINT AS revision
       FROM context_items c JOIN packs p ON p.id = c.pack_id LEFT JOIN (SELECT item_id, pack_id, arg_max(choice, decided_at || choice) AS choice, arg_max(baseline, decided_at || choice) AS baseline, max(decided_at) AS decided_at FROM decisions GROUP BY 1, 2) d ON d.item_id = c.id AND d.pack_id = c.pack_id""",
    "context_items", "packs", "decisions",
)
def decisions_applied(library: DataFrame, packs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items after decisions: excluded, or included as before; instants never go back, and a pack's revision counts the change once."""
    last = decisions.groupBy(F.col("item_id").alias("d"), F.col("pack_id").alias("d_pack")).agg(F.max_by(F.struct("choice", "baseline", "decided_at"), F.struct("decided_at", "choice")).alias("x"))
    touched = decisions.select(F.col("pack_id").alias("t")).distinct()
    own = packs.select(F.col("id").alias("p"), "revision").join(touched, F.col("p") == F.col("t"), "left")
    rows = library.join(own, F.col("pack_id") == F.col("p")).join(last, (F.col("id") == F.col("d")) & (F.col("pack_id") == F.col("d_pack")), "left")
    mode = F.coalesce(F.when(F.col("x.choice") == "exclude", "excluded").otherwise(F.col("x.baseline")), "inclusion_mode")
    return rows.select("id", "pack_id", mode.alias("inclusion_mode"), K.latest_instant(F.col("created_at"), F.col("x.decided_at")).alias("updated_at"), (F.col("revision") + F.col("t").isNotNull().cast("long")).alias("revision"))


@query(
    f"""SELECT id, reason, byte_count, CASE WHEN reason = 'unreferenced' THEN '{NOW}' ELSE created_at END AS created_at, CASE WHEN reason = 'unreferenced' THEN NULL ELSE purged_at END AS purged_at FROM quarantine
        UNION ALL SELECT event_id, 'unknown-file', CAST(floor(value) AS BIGINT), '{NOW}', NULL FROM events WHERE event_type = 'click'""",
    "quarantine", "events",
)
def quarantine_upsert(quarantine: DataFrame, events: DataFrame) -> DataFrame:
    """Files that come to quarantine again are not purged any more."""
    table = quarantine.select("id", "reason", "byte_count", "created_at", "purged_at")
    at = [F.lit(NOW).alias("created_at"), F.lit(None).cast("string").alias("purged_at")]
    changes = table.filter("reason = 'unreferenced'").select("id", "reason", "byte_count", *at)
    changes = changes.unionByName(events.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.lit("unknown-file").alias("reason"), F.floor("value").alias("byte_count"), *at))
    return K.upsert(table, changes, "id", ("reason", "byte_count", "created_at", "purged_at"), "created_at")


@query(
    f"""SELECT id, CASE WHEN purged_at IS NULL AND created_at <= '2024-01-15T00:00:00Z' THEN '{NOW}' ELSE purged_at END AS purged_at FROM quarantine""",
    "quarantine",
)
def quarantine_purged(quarantine: DataFrame) -> DataFrame:
    due = F.col("purged_at").isNull() & (F.col("created_at") <= "2024-01-15T00:00:00Z")
    return quarantine.select("id", F.when(due, F.lit(NOW)).otherwise(F.col("purged_at")).alias("purged_at"))


@query(
    """SELECT event_type AS id, count(*) + (event_type = 'error')::BIGINT * 5 AS occurrences, CASE WHEN event_type = 'error' THEN 'old' ELSE strftime(min(ts), '%Y') END AS first_seen, arg_max(event_id, event_id) AS last_event FROM events GROUP BY event_type""",
    "events",
)
def diagnostics_upsert(events: DataFrame) -> DataFrame:
    """Occurrences counted onto a table that has one code from before."""
    spark = events.sparkSession
    table = spark.range(1).select(F.lit("error").alias("id"), F.lit(5).cast("long").alias("occurrences"), F.lit("old").alias("first_seen"), F.lit(-1).cast("long").alias("last_event"))
    changes = events.select(F.col("event_type").alias("id"), F.date_format("ts", "yyyy").alias("first_seen"), F.col("event_id").alias("last_event"))
    return K.upsert(table, changes, "id", ("last_event",), "last_event", counter="occurrences")


_LIVE = "status = 'running' AND session_id = 'session-1' AND deadline_ms > 20000"


@query(
    f"""SELECT id, CASE WHEN {_LIVE} THEN CASE stage WHEN 'import' THEN 'running' WHEN 'extract' THEN 'running' WHEN 'analyze' THEN 'succeeded' ELSE 'failed' END ELSE status END AS status,
          CASE WHEN {_LIVE} AND stage IN ('import', 'extract') THEN CASE stage WHEN 'import' THEN 320000 ELSE deadline_ms END WHEN {_LIVE} THEN NULL ELSE deadline_ms END AS deadline_ms,
          CASE WHEN {_LIVE} AND stage NOT IN ('import', 'extract') THEN NULL ELSE session_id END AS session_id, {_LIVE.replace("status", "coalesce(status, '')").replace("session_id", "coalesce(session_id, '')").replace("deadline_ms", "coalesce(deadline_ms, 0)")} AS accepted,
          CASE WHEN {_LIVE} AND updated_at < '2024-01-10T00:00:00Z' THEN '2024-01-10T00:00:00Z' ELSE updated_at END AS updated_at FROM run_items""",
    "run_items",
)
def runs_settled(runs: DataFrame) -> DataFrame:
    """session-1 renews, checkpoints, completes or fails each run by its stage, at 20 s of its clock: only claims that it holds in time take it."""
    asked = runs.withColumn("action", F.when(F.col("stage") == "import", "renew").when(F.col("stage") == "extract", "checkpoint").when(F.col("stage") == "analyze", "complete").otherwise("fail"))
    from quirework.operators.states import settle_run

    return settle_run(asked, F.col("action"), "session-1", 20_000, 300_000, "2024-01-10T00:00:00Z").select("id", "status", "deadline_ms", "session_id", "accepted", "updated_at")


@query(
    """SELECT id, CASE WHEN ok THEN 'running' ELSE status END AS status, CASE WHEN ok THEN 'session-1' ELSE session_id END AS session_id, CASE WHEN ok THEN 320000 ELSE deadline_ms END AS deadline_ms, claim_version + ok::BIGINT AS claim_version, ok AS claimed
       FROM (SELECT *, coalesce(claim_version = 2 AND (status IN ('queued', 'recovering') OR (status = 'running' AND (session_id IS NULL OR session_id <> 'session-1' OR deadline_ms IS NULL OR deadline_ms <= 20000))), false) AS ok FROM run_items)""",
    "run_items",
)
def claim_runs(runs: DataFrame) -> DataFrame:
    """session-1 claims every run, expecting claim version 2, at 20 s of its clock for five minutes: waiting runs and such whose claim is over or another session's."""
    from quirework.operators.states import claim_run

    return claim_run(runs, F.lit(2), "session-1", 20_000, 300_000).select("id", "status", "session_id", "deadline_ms", "claim_version", "claimed")


@query(
    f"""SELECT id, CASE WHEN a THEN 'cancelled' ELSE status END AS status, CASE WHEN a AND updated_at < '{NOW}' THEN '{NOW}' ELSE updated_at END AS updated_at, CASE WHEN a THEN CASE WHEN updated_at < '{NOW}' THEN '{NOW}' ELSE updated_at END END AS completed_at
        FROM (SELECT *, status IN ('queued', 'running', 'recovering') AS a FROM run_items)""",
    "run_items",
)
def cancel_runs(runs: DataFrame) -> DataFrame:
    """Active runs end; their instants never go back."""
    active, at = F.col("status").isin("queued", "running", "recovering"), K.latest_instant(F.col("updated_at"), F.lit(NOW))
    return runs.select("id", F.when(active, "cancelled").otherwise(F.col("status")).alias("status"), F.when(active, at).otherwise(F.col("updated_at")).alias("updated_at"), F.when(active, at).alias("completed_at"))


@query(
    """SELECT 'artifact_references' AS target, count(*) AS remaining FROM artifact_references r WHERE NOT (r.owner_type = 'export' AND r.owner_id IN (SELECT CAST(e.id AS VARCHAR) FROM export_records e JOIN packs p ON p.id = e.pack_id WHERE p.deleted_at IS NOT NULL))
         AND NOT (r.owner_type = 'context-item' AND r.owner_id IN (SELECT c.id FROM context_items c JOIN packs p ON p.id = c.pack_id WHERE p.deleted_at IS NOT NULL))
       UNION ALL SELECT 'context_items', count(*) FROM context_items c JOIN packs p ON p.id = c.pack_id WHERE p.deleted_at IS NULL
       UNION ALL SELECT 'export_records', count(*) FROM export_records e JOIN packs p ON p.id = e.pack_id WHERE p.deleted_at IS NULL
       UNION ALL SELECT 'export_artifacts', count(*) FROM export_artifacts a WHERE a.export_id NOT IN (SELECT e.id FROM export_records e JOIN packs p ON p.id = e.pack_id WHERE p.deleted_at IS NOT NULL)
       UNION ALL SELECT 'packs', count(*) FROM packs WHERE deleted_at IS NULL""",
    "artifact_references", "context_items", "export_records", "export_artifacts", "packs",
)
def delete_cascade(references: DataFrame, library: DataFrame, exports: DataFrame, parts: DataFrame, packs: DataFrame) -> DataFrame:
    """What stays in each table when deleted packs go: their items, exports, and the references of both."""
    gone = packs.filter("deleted_at is not null").select("id")
    kept_items, kept_exports = K.delete_where_in(library, "pack_id", gone, "id"), K.delete_where_in(exports, "pack_id", gone, "id")
    lost = lambda table: table.join(gone.select(F.col("id").alias("g")), F.col("pack_id") == F.col("g"), "left_semi").select(F.col("id").alias("lost"))
    owners = lost(library).select(F.lit("context-item").alias("kind"), "lost").unionByName(lost(exports).select(F.lit("export").alias("kind"), F.col("lost").cast("string").alias("lost")))
    kept_refs = references.join(owners, (F.col("owner_type") == F.col("kind")) & (F.col("owner_id") == F.col("lost")), "left_anti")
    kept_parts = K.delete_where_in(parts, "export_id", lost(exports), "lost")
    n = lambda table, name: table.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("target"), "remaining")
    out = n(kept_refs, "artifact_references")
    for table, name in ((kept_items, "context_items"), (kept_exports, "export_records"), (kept_parts, "export_artifacts"), (packs.filter("deleted_at is null"), "packs")):
        out = out.unionByName(n(table, name))
    return out


@query(
    """SELECT r.owner_type, r.owner_id, r.artifact_id FROM artifact_references r WHERE NOT (r.owner_type = 'context-item' AND r.owner_id IN (SELECT id FROM context_items WHERE state IN ('failed', 'cancelled')))
       UNION ALL SELECT DISTINCT 'library-item', a.item_id, a.id FROM artifacts a WHERE a.kind = 'original' AND a.item_id IN (SELECT id FROM context_items WHERE state = 'failed')""",
    "artifact_references", "artifacts", "context_items",
)
def items_removed(references: DataFrame, artifacts: DataFrame, library: DataFrame) -> DataFrame:
    """Failed items go and keep their originals in the library; cancelled ones go and release them."""
    gone = library.filter(F.col("state").isin("failed", "cancelled")).select(F.col("id").alias("g"))
    stay = references.join(gone, (F.col("owner_type") == "context-item") & (F.col("owner_id") == F.col("g")), "left_anti")
    kept = library.filter("state = 'failed'").select(F.col("id").alias("g"))
    own = artifacts.filter("kind = 'original'").join(kept, F.col("item_id") == F.col("g"), "left_semi").select(F.lit("library-item").alias("owner_type"), F.col("item_id").alias("owner_id"), F.col("id").alias("artifact_id"))
    return K.insert_or_ignore(stay, own, "owner_type", "owner_id", "artifact_id")


@query("SELECT id, pack_id, row_number() OVER (PARTITION BY pack_id ORDER BY import_id, sort_index, id) - 1 AS sort_index FROM context_items WHERE state <> 'cancelled'", "context_items")
def reindexed(library: DataFrame) -> DataFrame:
    """Places without gaps after cancelled items were removed."""
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("import_id", "sort_index", "id")) - 1
    return library.filter("state <> 'cancelled'").select("id", "pack_id", place.cast("long").alias("sort_index"))


@query(f"SELECT a.id, CASE WHEN f.path IS NOT NULL AND f.content = a.text THEN '{NOW}' END AS last_verified_at FROM file_artifacts a LEFT JOIN file_store f ON f.path = a.relative_path", "file_artifacts", "file_store")
def marked_verified(artifacts: DataFrame, store: DataFrame) -> DataFrame:
    known = artifacts.select("id", "relative_path", F.octet_length("text").cast("long").alias("byte_count"), F.sha2("text", 256).alias("sha256"))
    there = store.select("path", F.octet_length("content").cast("long").alias("byte_count"), F.sha2("content", 256).alias("sha256"))
    return files.verify(known, there).select("id", F.when(F.col("status") == "verified", F.lit(NOW)).alias("last_verified_at"))


@query("SELECT i.item_id || '/o' AS id, i.item_id, 'original' AS kind, i.media_type, i.byte_count, '{\"name\":\"import\",\"version\":\"1\"}' AS processor_version, m.created_at FROM import_items i JOIN imports m ON m.import_id = i.import_id WHERE i.status = 'copied'", "import_items", "imports")
def backfill_artifacts(items: DataFrame, imports: DataFrame) -> DataFrame:
    rows = items.filter("status = 'copied'").join(imports.select("import_id", "created_at"), "import_id")
    version = F.to_json(F.struct(F.lit("import").alias("name"), F.lit("1").alias("version")))
    return rows.select(F.concat("item_id", F.lit("/o")).alias("id"), "item_id", F.lit("original").alias("kind"), "media_type", "byte_count", version.alias("processor_version"), "created_at")


@query("SELECT id, CASE WHEN updated_at = '' THEN created_at ELSE updated_at END AS updated_at FROM (SELECT id, created_at, CASE WHEN state = 'received' THEN '' ELSE created_at || '+' END AS updated_at FROM context_items)", "context_items")
def backfill_updated_at(library: DataFrame) -> DataFrame:
    given = F.when(F.col("state") == "received", "").otherwise(F.concat("created_at", F.lit("+")))
    return library.select("id", F.when(given == "", F.col("created_at")).otherwise(given).alias("updated_at"))


@query(
    """WITH acts AS (SELECT *, CASE group_id % 3 WHEN 0 THEN 'keep-all' WHEN 1 THEN 'exclude' ELSE 'preferred' END AS action, min(left_id) OVER (PARTITION BY group_id) AS target FROM stored_suggestions),
       members AS (SELECT DISTINCT group_id, action, target, left_id AS item_id FROM acts UNION SELECT DISTINCT group_id, action, target, right_id FROM acts),
       covered AS (SELECT DISTINCT group_id, right_id AS item_id FROM acts WHERE left_id = target UNION SELECT DISTINCT group_id, left_id FROM acts WHERE right_id = target),
       prior AS (SELECT item_id, arg_max(choice, decided_at || choice) AS choice, arg_max(baseline, decided_at || choice) AS baseline, arg_max(source, decided_at || choice) AS source FROM decisions GROUP BY item_id),
       modes AS (SELECT id, min(inclusion_mode) AS mode FROM context_items GROUP BY id)
       SELECT m.group_id, m.item_id,
         CASE m.action WHEN 'keep-all' THEN 'keep' WHEN 'exclude' THEN 'exclude' ELSE CASE WHEN m.item_id = m.target THEN 'preferred' WHEN c.item_id IS NOT NULL THEN 'exclude' ELSE 'keep' END END AS choice,
         coalesce(p.baseline, o.mode) AS baseline,
         CASE WHEN m.action <> 'preferred' THEN 'standalone' WHEN m.item_id <> m.target AND c.item_id IS NOT NULL AND coalesce(p.choice = 'exclude' AND p.source <> 'preferred-group', false) THEN 'standalone' ELSE 'preferred-group' END AS source
       FROM members m LEFT JOIN covered c ON c.group_id = m.group_id AND c.item_id = m.item_id LEFT JOIN prior p ON p.item_id = m.item_id LEFT JOIN modes o ON o.id = m.item_id
       WHERE m.action = 'keep-all' OR (m.action = 'exclude' AND m.item_id = m.target) OR (m.action = 'preferred' AND (m.item_id = m.target OR c.item_id IS NOT NULL OR p.source = 'preferred-group'))""",
    "stored_suggestions", "decisions", "context_items",
)
def group_actions(stored: DataFrame, decisions: DataFrame, library: DataFrame) -> DataFrame:
    """Each order's items as a group, on which one of three actions is taken, with what was decided before."""
    edges = stored.select("group_id", "left_id", "right_id")
    kind = F.when(F.col("group_id") % 3 == 0, "keep-all").when(F.col("group_id") % 3 == 1, "exclude").otherwise("preferred")
    actions = edges.groupBy("group_id").agg(F.min("left_id").alias("target")).select("group_id", kind.alias("action"), "target")
    prior = decisions.groupBy("item_id").agg(F.max_by(F.struct("choice", "baseline", "source"), F.struct("decided_at", "choice")).alias("p")).select("item_id", "p.*")
    modes = library.groupBy(F.col("id").alias("item_id")).agg(F.min("inclusion_mode").alias("inclusion_mode"))
    return dedup.group_decisions(edges, actions, prior, modes)


@query(
    f"""SELECT f.path, CASE WHEN f.path LIKE 'Quarantine/%' THEN CASE WHEN f.modified <= epoch_ms(TIMESTAMP '{CUTOFF[:10]}') - 604800000 THEN 'purge' ELSE 'keep' END WHEN j.pack_id IS NOT NULL OR f.modified > epoch_ms(TIMESTAMP '{CUTOFF[:10]}') - 86400000 THEN 'keep'
          WHEN a.relative_path IS NULL THEN 'quarantine' WHEN NOT a.used THEN 'delete' ELSE 'keep' END AS action
        FROM (SELECT relative_path || CASE WHEN kind = 'normalized-text' THEN '.partial' ELSE '' END AS path, max(epoch_ms(CAST(substr(created_at, 1, 10) AS TIMESTAMP))) AS modified FROM artifacts GROUP BY 1 UNION ALL SELECT 'Quarantine/' || CAST(import_id AS VARCHAR), epoch_ms(CAST(substr(created_at, 1, 10) AS TIMESTAMP)) FROM imports) f
        LEFT JOIN (SELECT relative_path, bool_or(id IN (SELECT artifact_id FROM artifact_references)) AS used FROM artifacts GROUP BY relative_path) a ON a.relative_path = f.path
        LEFT JOIN (SELECT DISTINCT CAST(pack_id AS VARCHAR) AS pack_id FROM journal WHERE phase = 'discovered') j ON j.pack_id = split_part(f.path, '/', 2)""",
    "artifacts", "artifact_references", "imports", "journal",
)
def garbage(artifacts: DataFrame, references: DataFrame, imports: DataFrame, journal: DataFrame) -> DataFrame:
    """Files of all ages: some were never finished, some lie in quarantine, and those of recovering packs are spared."""
    millis = F.unix_millis(F.to_timestamp(F.substring("created_at", 1, 10)))
    own = artifacts.select(F.concat("relative_path", F.when(F.col("kind") == "normalized-text", ".partial").otherwise("")).alias("path"), millis.alias("m")).groupBy("path").agg(F.max("m").alias("modified_ms"))
    away = imports.select(F.concat(F.lit("Quarantine/"), F.col("import_id").cast("string")).alias("path"), millis.alias("modified_ms"))
    recovering = journal.filter("phase = 'discovered'").select("pack_id")
    return files.cleanup(own.unionByName(away), artifacts, references, 883_612_800_000, recovering)


@query(
    """SELECT user_id AS ingestion_id, arg_max(event_id % 7, rank * 1000000 + event_id) AS pack_id, arg_max(phase, rank * 1000000 + event_id) AS phase, max(rank * 1000000 + event_id) % 1000000 AS updated_at FROM (
         SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS rank, CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'handoff-started' WHEN 'signup' THEN 'files-published' WHEN 'purchase' THEN 'database-committed' END AS phase FROM events) WHERE rank > 0 GROUP BY user_id""",
    "events",
)
def journal_phases(events: DataFrame) -> DataFrame:
    """Events as entries of a user's recovery; one kind is no phase."""
    phase = F.when(F.col("event_type") == "view", "discovered").when(F.col("event_type") == "click", "handoff-started").when(F.col("event_type") == "signup", "files-published").when(F.col("event_type") == "purchase", "database-committed").otherwise("unknown")
    entries = events.select(F.col("user_id").alias("ingestion_id"), (F.col("event_id") % 7).alias("pack_id"), phase.alias("phase"), F.col("event_id").alias("updated_at"), F.lit(None).cast("string").alias("error_code"))
    return E.recovery_journal(entries).select("ingestion_id", "pack_id", "phase", "updated_at")


@query(
    """WITH turns AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) + 3 AS pages FROM conversations),
       bad AS (SELECT DISTINCT conv_id FROM turns WHERE conv_id % 5 = 0 OR (conv_id % 5 = 1 AND turn % 4 <> 1 AND turn % 3 = 0)),
       whole AS (SELECT DISTINCT conv_id, CAST(unnest(range(pages)) AS BIGINT) AS page FROM turns)
       SELECT w.conv_id AS task_id, w.page AS page_index, NULL AS error_code FROM whole w WHERE w.conv_id NOT IN (SELECT conv_id FROM bad)
         AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = w.conv_id AND t.turn = w.page AND NOT (t.turn % 4 = 1 AND t.turn % 3 = 0 AND t.conv_id % 5 = 1))
       UNION ALL SELECT conv_id, NULL, 'PDF_RESULT_INVALID' FROM bad""",
    "conversations",
)
def page_recovery(turns: DataFrame) -> DataFrame:
    """Conversations as documents with three pages more than turns, whose turns are committed pages, some failed; some
    checkpoints are of another document, and some tasks retry pages of which not all failed."""
    counts = turns.groupBy(F.col("conv_id").alias("task_id")).agg((F.max("turn") + 3).cast("long").alias("page_count"))
    tasks = counts.select("task_id", F.lit("a").alias("sha256"), F.lit("latin").alias("script"), "page_count")
    rows = turns.select(F.col("conv_id").alias("task_id"), F.col("turn").cast("long").alias("page_index")).join(counts, "task_id")
    committed = rows.select("task_id", F.when(F.col("task_id") % 5 == 0, "b").otherwise("a").alias("sha256"), F.lit("latin").alias("script"), "page_count", "page_index", F.when(F.col("page_index") % 4 == 1, "failed").otherwise("complete").alias("status"))
    retries = rows.filter("task_id % 5 = 1 and page_index % 3 = 0").select("task_id", "page_index")
    return pages.remaining_pages(tasks, committed.dropDuplicates(["task_id", "page_index"]), retries)


@query(
    """SELECT conv_id AS pack_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(coalesce(text, ''))) AS place, 'attachments/' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256(coalesce(text, ''))) AS VARCHAR), 4, '0') || '-' || role || '.txt' AS relative_path,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS byte_count, sha256(coalesce(text, '')) AS sha256 FROM conversations""",
    "conversations",
)
def attachment_bundle(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").alias("pack_id"), F.col("turn").alias("sort_index"), F.col("role").alias("title"), F.lit("txt").alias("extension"), F.octet_length(text).cast("long").alias("byte_count"), F.sha2(text, 256).alias("sha256"))
    return privacy.bundle(rows)
