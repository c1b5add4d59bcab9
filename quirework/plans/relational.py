"""The statements over the tables of a document library, each a query over catalog views.

Correlated subqueries are one aggregate and one join here; upserts and updates give the table as it is after them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators.tables import placed
from quirework.sources.catalog import ITEM_STATES, VIEWS, ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A moment that cleanup is run at, by ISO text as the tables hold it.
CUTOFF = "1998-01-01T00:00:00Z"
NOW = "2024-06-01T00:00:00Z"


def query(sql: str, *views: str):
    """Register a function of the named views under its own name, with its SQL over them."""

    def add(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(*(load(spark, sf_dir, v) for v in views))

        QUERIES[plan.__name__] = run
        own = [v for v in views if v in VIEWS]
        ORACLE_SQL[plan.__name__] = (ctes(*own) + (f", {sql[5:]}" if sql.startswith("WITH ") else sql)) if own else sql
        return plan

    return add


@query(
    """SELECT i.item_id AS id, m.pack_id, CASE WHEN lower(i.media_type) LIKE 'image/%' THEN 'image' WHEN lower(i.media_type) = 'application/pdf' THEN 'pdf'
         WHEN lower(i.media_type) = 'text/uri-list' THEN 'url' ELSE 'text' END AS source_type,
         (SELECT min(a.sha256) FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') AS original_sha256,
         CASE WHEN i.status = 'copied' THEN 'imported' ELSE 'failed' END AS state, 'both' AS inclusion_mode,
         row_number() OVER (PARTITION BY m.pack_id ORDER BY m.created_at, i.sort_index, i.item_id) - 1 AS sort_index, m.created_at
       FROM import_items i JOIN imports m ON m.import_id = i.import_id""",
    "import_items", "imports", "artifacts",
)
def backfill_items(items: DataFrame, imports: DataFrame, artifacts: DataFrame) -> DataFrame:
    m = F.lower("media_type")
    kind = F.when(m.like("image/%"), "image").when(m == "application/pdf", "pdf").when(m == "text/uri-list", "url").otherwise("text")
    originals = artifacts.filter("kind = 'original'").groupBy(F.col("item_id").alias("a_item")).agg(F.min("sha256").alias("original_sha256"))
    rows = items.join(imports.select("import_id", "pack_id", "created_at"), "import_id").join(originals, F.col("item_id") == F.col("a_item"), "left")
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("created_at", "sort_index", "item_id")) - 1
    return rows.select(F.col("item_id").alias("id"), "pack_id", kind.alias("source_type"), "original_sha256", F.when(F.col("status") == "copied", "imported").otherwise("failed").alias("state"), F.lit("both").alias("inclusion_mode"), place.cast("long").alias("sort_index"), "created_at")


@query(
    """SELECT m.import_id, m.pack_id, m.status, (SELECT count(*) FROM import_items i WHERE i.import_id = m.import_id) AS items,
         (SELECT count(*) FROM import_items i JOIN context_items c ON c.id = i.item_id WHERE i.import_id = m.import_id AND c.state = 'failed') AS failed
       FROM imports m""",
    "imports", "import_items", "context_items",
)
def import_summary(imports: DataFrame, items: DataFrame, library: DataFrame) -> DataFrame:
    failed = library.filter("state = 'failed'").select(F.col("id").alias("item_id"), F.lit(1).alias("failed"))
    # Both counts from one pass over the items.
    counts = items.select("import_id", "item_id").join(failed, "item_id", "left").groupBy(F.col("import_id").alias("of")).agg(F.count("*").alias("n"), F.count("failed").alias("f"))
    rows = imports.join(counts, F.col("import_id") == F.col("of"), "left")
    return rows.select("import_id", "pack_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("items"), F.coalesce("f", F.lit(0)).cast("long").alias("failed"))


@query("SELECT import_id, created_at, row_number() OVER (ORDER BY created_at DESC, import_id) AS place FROM imports", "imports")
def newest_imports(imports: DataFrame) -> DataFrame:
    """All imports, newest first: ranges of the order are sorted, and none of them whole in one task."""
    return placed(imports.select("import_id", "created_at"), F.desc("created_at"), "import_id")


@query(
    """SELECT i.item_id, i.import_id, (SELECT count(*) FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') AS originals,
         (SELECT max(a.relative_path) FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') AS relative_path,
         (SELECT max(a.byte_count) FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') AS byte_count,
         (SELECT max(a.sha256) FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') AS sha256 FROM import_items i""",
    "import_items", "artifacts",
)
def item_originals(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    own = artifacts.filter("kind = 'original'").groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n"), F.max("relative_path").alias("relative_path"), F.max("byte_count").alias("byte_count"), F.max("sha256").alias("sha256"))
    return items.select("item_id", "import_id").join(own, F.col("item_id") == F.col("of"), "left").select("item_id", "import_id", F.coalesce("n", F.lit(0)).cast("long").alias("originals"), "relative_path", "byte_count", "sha256")


@query("SELECT i.import_id, i.item_id, c.state, c.pack_id FROM import_items i JOIN context_items c ON c.id = i.item_id", "import_items", "context_items")
def import_library_items(items: DataFrame, library: DataFrame) -> DataFrame:
    return items.join(library.select("id", "state", "pack_id"), F.col("item_id") == F.col("id")).select("import_id", "item_id", "state", "pack_id")


@query("SELECT p.id AS pack_id, coalesce(max(c.sort_index) + 1, 0) AS next_index, count(c.id) AS items FROM packs p LEFT JOIN context_items c ON c.pack_id = p.id GROUP BY p.id", "packs", "context_items")
def next_sort_index(packs: DataFrame, library: DataFrame) -> DataFrame:
    own = library.groupBy(F.col("pack_id").alias("of")).agg(F.max("sort_index").alias("m"), F.count("*").alias("n"))
    return packs.join(own, F.col("id") == F.col("of"), "left").select(F.col("id").alias("pack_id"), F.coalesce(F.col("m") + 1, F.lit(0)).cast("long").alias("next_index"), F.coalesce("n", F.lit(0)).cast("long").alias("items"))


@query("SELECT id, title, state, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM packs WHERE deleted_at IS NULL", "packs")
def live_packs(packs: DataFrame) -> DataFrame:
    return placed(packs.filter("deleted_at is null").select("id", "title", "state", "updated_at"), F.desc("updated_at"), "id")


@query(
    """SELECT p.id, p.state, count(c.id) AS items, string_agg(c.id, ',' ORDER BY c.import_id, c.sort_index, c.id) AS ordered_items
       FROM packs p LEFT JOIN context_items c ON c.pack_id = p.id WHERE p.deleted_at IS NULL GROUP BY p.id, p.state""",
    "packs", "context_items",
)
def pack_graph(packs: DataFrame, library: DataFrame) -> DataFrame:
    own = library.groupBy(F.col("pack_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("import_id", "sort_index", "id"))).alias("i"))
    rows = packs.filter("deleted_at is null").join(own, F.col("id") == F.col("of"), "left")
    return rows.select("id", "state", F.coalesce(F.size("i"), F.lit(0)).cast("long").alias("items"), F.array_join(F.transform("i", lambda x: x["id"]), ",").alias("ordered_items"))


@query(
    """SELECT id, stage, status FROM runs WHERE status IN ('queued', 'recovering') OR (status = 'running' AND (session_id <> 'session-1' OR deadline_ms IS NULL OR deadline_ms <= 20000))""",
    "runs",
)
def runnable_runs(runs: DataFrame) -> DataFrame:
    """Runs that session-1 may claim at 20 s on its clock: such that wait, and running ones of other sessions or past their deadline."""
    free = F.col("status").isin("queued", "recovering") | ((F.col("status") == "running") & ((F.col("session_id") != "session-1") | F.col("deadline_ms").isNull() | (F.col("deadline_ms") <= 20_000)))
    return runs.filter(free).select("id", "stage", "status")


@query("SELECT pack_id, max(id) AS latest_run, arg_max(status, id) AS status FROM runs GROUP BY pack_id", "runs")
def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pack_id").agg(F.max("id").alias("latest_run"), F.max_by("status", "id").alias("status"))


@query(
    """SELECT pack_id, count(DISTINCT artifact_id) AS artifacts FROM (
         SELECT c.pack_id, r.artifact_id FROM artifact_references r JOIN context_items c ON c.id = r.owner_id WHERE r.owner_type = 'context-item'
         UNION ALL SELECT i.pack_id, r.artifact_id FROM artifact_references r JOIN imports i ON CAST(i.import_id AS VARCHAR) = r.owner_id WHERE r.owner_type = 'export') GROUP BY pack_id""",
    "artifact_references", "context_items", "imports",
)
def ref_distinct_count(references: DataFrame, library: DataFrame, imports: DataFrame) -> DataFrame:
    """The count for every pack at once: the OR of two owners is a union of two joins."""
    items = library.select(F.lit("context-item").alias("kind"), F.col("id").alias("o"), "pack_id")
    exports = imports.select(F.lit("export").alias("kind"), F.col("import_id").cast("string").alias("o"), "pack_id")
    owners = items.unionByName(exports)
    return references.join(owners, (F.col("owner_type") == F.col("kind")) & (F.col("owner_id") == F.col("o"))).groupBy("pack_id").agg(F.countDistinct("artifact_id").alias("artifacts"))


@query(
    """SELECT c.id, c.state, (SELECT count(*) FROM artifacts a WHERE a.item_id = c.id AND a.kind = 'original') AS originals,
         (SELECT min(a.sha256) FROM artifacts a WHERE a.item_id = c.id AND a.kind = 'original') = c.original_sha256 AS same_hash
       FROM context_items c WHERE c.state IN ('analyzed', 'reviewed')""",
    "context_items", "artifacts",
)
def analysis_integrity(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    own = artifacts.filter("kind = 'original'").groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n"), F.min_by("sha256", "id").alias("s"))
    rows = library.filter(F.col("state").isin("analyzed", "reviewed")).join(own, F.col("id") == F.col("of"), "left")
    return rows.select("id", "state", F.coalesce("n", F.lit(0)).cast("long").alias("originals"), (F.col("s") == F.col("original_sha256")).alias("same_hash"))


@query(
    """SELECT count(*) AS artifacts, CAST(coalesce(sum(byte_count), 0) AS BIGINT) AS bytes, count(DISTINCT sha256) AS contents,
         (SELECT CAST(coalesce(sum(byte_count), 0) AS BIGINT) FROM artifacts WHERE id IN (SELECT artifact_id FROM artifact_references)) AS referenced_bytes,
         (SELECT count(*) FROM context_items WHERE state = 'failed') AS failed_items, (SELECT count(*) FROM packs WHERE deleted_at IS NOT NULL) AS deleted_packs FROM artifacts""",
    "artifacts", "artifact_references", "context_items", "packs",
)
def storage_usage(artifacts: DataFrame, references: DataFrame, library: DataFrame, packs: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    whole = artifacts.agg(F.count("*").alias("artifacts"), total("byte_count").alias("bytes"), F.countDistinct("sha256").alias("contents"))
    used = artifacts.join(references.select(F.col("artifact_id").alias("r")), F.col("id") == F.col("r"), "left_semi").agg(total("byte_count").alias("referenced_bytes"))
    failed = library.agg(F.count_if(F.col("state") == "failed").alias("failed_items"))
    gone = packs.agg(F.count("deleted_at").alias("deleted_packs"))
    # Each side has one row.
    return whole.crossJoin(F.broadcast(used)).crossJoin(F.broadcast(failed)).crossJoin(F.broadcast(gone))


@query("SELECT DISTINCT a.relative_path FROM artifacts a JOIN artifact_references r ON r.artifact_id = a.id", "artifacts", "artifact_references")
def referenced_paths(artifacts: DataFrame, references: DataFrame) -> DataFrame:
    return artifacts.join(references.select(F.col("artifact_id").alias("r")), F.col("id") == F.col("r"), "left_semi").select("relative_path").distinct()


@query(
    """SELECT DISTINCT path FROM (SELECT relative_path AS path FROM artifacts UNION ALL SELECT 'Events/' || CAST(json_extract(props, '$.k') AS VARCHAR) FROM events)""",
    "artifacts", "events",
)
def known_paths(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Paths of artifacts, and such that JSON payloads hold."""
    held = F.concat(F.lit("Events/"), F.from_json("props", "k long")["k"].cast("string"))
    return artifacts.select(F.col("relative_path").alias("path")).unionByName(events.select(held.alias("path"))).distinct()


@query(f"SELECT id, relative_path FROM artifacts a WHERE created_at < '{CUTOFF}' AND NOT EXISTS (SELECT 1 FROM artifact_references r WHERE r.artifact_id = a.id)", "artifacts", "artifact_references")
def cleanup_candidates(artifacts: DataFrame, references: DataFrame) -> DataFrame:
    return artifacts.filter(F.col("created_at") < CUTOFF).join(references.select(F.col("artifact_id").alias("r")), F.col("id") == F.col("r"), "left_anti").select("id", "relative_path")


@query("SELECT a.id, a.kind, EXISTS (SELECT 1 FROM artifact_references r WHERE r.artifact_id = a.id) AS referenced FROM artifacts a", "artifacts", "artifact_references")
def existence_flag(artifacts: DataFrame, references: DataFrame) -> DataFrame:
    seen = references.select(F.col("artifact_id").alias("r")).distinct()
    return artifacts.join(seen, F.col("id") == F.col("r"), "left").select("id", "kind", F.col("r").isNotNull().alias("referenced"))


@query("SELECT DISTINCT a.id, c.pack_id FROM artifacts a JOIN artifact_references r ON r.artifact_id = a.id JOIN context_items c ON c.id = r.owner_id WHERE r.owner_type = 'context-item' AND a.kind = 'original'", "artifacts", "artifact_references", "context_items")
def pack_originals(artifacts: DataFrame, references: DataFrame, library: DataFrame) -> DataFrame:
    held = references.filter("owner_type = 'context-item'").join(library.select(F.col("id").alias("c"), "pack_id"), F.col("owner_id") == F.col("c")).select("artifact_id", "pack_id").distinct()
    return artifacts.filter("kind = 'original'").select("id").distinct().join(held, F.col("id") == F.col("artifact_id")).select("id", "pack_id")


@query("SELECT r.id, r.status, p.revision, p.state FROM runs r JOIN packs p ON p.id = r.pack_id WHERE p.deleted_at IS NULL AND r.status IN ('running', 'recovering')", "runs", "packs")
def settlement(runs: DataFrame, packs: DataFrame) -> DataFrame:
    live = packs.filter("deleted_at is null").select(F.col("id").alias("p"), "revision", "state")
    return runs.filter(F.col("status").isin("running", "recovering")).join(live, F.col("pack_id") == F.col("p")).select("id", "status", "revision", "state")


_RETRY = """CASE WHEN state NOT IN ('recovering', 'failed', 'cancelled') THEN NULL WHEN EXISTS (SELECT 1 FROM import_items i WHERE i.item_id = c.id AND i.status = 'failed') THEN 'import'
         WHEN original_sha256 IS NULL THEN 'import' WHEN EXISTS (SELECT 1 FROM artifacts a WHERE a.item_id = c.id AND a.kind IN ('ocr-text', 'pdf-page-text')) THEN 'analyze' ELSE 'extract' END"""


@query(f"SELECT c.id, c.state, {_RETRY} AS retry_stage FROM context_items c", "context_items", "import_items", "artifacts")
def retry_stage(library: DataFrame, items: DataFrame, artifacts: DataFrame) -> DataFrame:
    failed = items.filter("status = 'failed'").select(F.col("item_id").alias("f")).distinct()
    read = artifacts.filter("kind in ('ocr-text', 'pdf-page-text')").select(F.col("item_id").alias("t")).distinct()
    rows = library.join(failed, F.col("id") == F.col("f"), "left").join(read, F.col("id") == F.col("t"), "left")
    stage = F.when(F.col("f").isNotNull() | F.col("original_sha256").isNull(), "import").when(F.col("t").isNotNull(), "analyze").otherwise("extract")
    return rows.select("id", "state", F.when(F.col("state").isin("recovering", "failed", "cancelled"), stage).alias("retry_stage"))


@query(
    """SELECT i.item_id, CASE WHEN i.status = 'failed' AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.item_id = i.item_id AND a.kind = 'original') THEN 'unavailable'
         WHEN NOT EXISTS (SELECT 1 FROM context_items c WHERE c.id = i.item_id)
          AND NOT EXISTS (SELECT 1 FROM artifacts a JOIN artifact_references r ON r.artifact_id = a.id WHERE a.item_id = i.item_id AND a.kind = 'original') THEN 'released'
         ELSE 'retained' END AS disposition FROM import_items i""",
    "import_items", "artifacts", "artifact_references", "context_items",
)
def disposition(items: DataFrame, artifacts: DataFrame, references: DataFrame, library: DataFrame) -> DataFrame:
    seen = references.select(F.col("artifact_id").alias("r")).distinct()
    own = artifacts.filter("kind = 'original'").join(seen, F.col("id") == F.col("r"), "left").groupBy(F.col("item_id").alias("a")).agg(F.count("r").alias("refs"))
    rows = items.select("item_id", "status").join(own, F.col("item_id") == F.col("a"), "left").join(library.select(F.col("id").alias("c")).distinct(), F.col("item_id") == F.col("c"), "left")
    kind = F.when((F.col("status") == "failed") & F.col("a").isNull(), "unavailable").when(F.col("c").isNull() & (F.coalesce("refs", F.lit(0)) == 0), "released").otherwise("retained")
    return rows.select("item_id", kind.alias("disposition"))


@query("SELECT event_type AS code, user_id AS subject, count(*) AS occurrences, min(event_id) AS first_seen, max(event_id) AS last_seen, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type, user_id", "events")
def diagnostics_rollup(events: DataFrame) -> DataFrame:
    """What upserts that count occurrences come to."""
    return events.groupBy(F.col("event_type").alias("code"), F.col("user_id").alias("subject")).agg(F.count("*").alias("occurrences"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.max_by("value", "event_id").alias("last_value"))


@query("SELECT a.id FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM context_items c JOIN packs p ON p.id = c.pack_id WHERE c.id = a.item_id AND p.deleted_at IS NOT NULL)", "artifacts", "context_items", "packs")
def delete_packs(artifacts: DataFrame, library: DataFrame, packs: DataFrame) -> DataFrame:
    """Artifacts that stay when the deleted packs' items go."""
    gone = library.join(packs.filter("deleted_at is not null").select(F.col("id").alias("p")), F.col("pack_id") == F.col("p"), "left_semi").select(F.col("id").alias("c"))
    return artifacts.join(gone, F.col("item_id") == F.col("c"), "left_anti").select("id")


@query("SELECT id, pack_id, CASE WHEN original_sha256 IS NOT NULL THEN nullif(first_value(id) OVER (PARTITION BY pack_id, original_sha256 ORDER BY sort_index, id), id) END AS duplicate_of FROM context_items", "context_items")
def first_by_hash(library: DataFrame) -> DataFrame:
    from quirework.operators.dedup import mark_originals

    return mark_originals(library).select("id", "pack_id", "duplicate_of")


@query("SELECT pack_id, import_id, status, created_at FROM imports QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY created_at DESC, import_id DESC) = 1", "imports")
def newest_import(imports: DataFrame) -> DataFrame:
    best = imports.groupBy("pack_id").agg(F.max_by(F.struct("import_id", "status", "created_at"), F.struct("created_at", "import_id")).alias("i"))
    return best.select("pack_id", "i.*")


@query(
    """SELECT coalesce(i.item_id, a.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'missing' WHEN i.item_id IS NULL THEN 'extra' WHEN i.byte_count <> a.byte_count OR i.sha256 <> a.sha256 OR i.relative_path <> a.relative_path OR i.media_type <> a.media_type THEN 'mismatch' ELSE 'same' END AS verdict
       FROM (SELECT item_id, byte_count, media_type, md5(split_part(item_id, '-', 3)) AS sha256, 'Packs/' || import_id || '/Originals/' || split_part(item_id, '-', 3) || '-' || sort_index AS relative_path FROM import_items WHERE status = 'copied') i
       FULL OUTER JOIN (SELECT a.item_id, a.byte_count, a.sha256, a.relative_path, CASE WHEN c.source_type = 'pdf' THEN 'application/pdf' ELSE c.media_type END AS media_type FROM artifacts a LEFT JOIN (
         SELECT i.item_id AS id, i.media_type, c.source_type FROM import_items i LEFT JOIN (SELECT DISTINCT id, source_type FROM context_items) c ON c.id = i.item_id) c ON c.id = a.item_id WHERE a.kind = 'original') a ON a.item_id = i.item_id""",
    "import_items", "artifacts", "context_items",
)
def reconcile(items: DataFrame, artifacts: DataFrame, library: DataFrame) -> DataFrame:
    """Every copied item of the manifests against every original, by id, size, hash, path and media type."""
    part = F.get(F.split("item_id", "-"), 2)
    path = F.concat(F.lit("Packs/"), F.col("import_id").cast("string"), F.lit("/Originals/"), part, F.lit("-"), F.col("sort_index").cast("string"))
    i = items.filter("status = 'copied'").select(F.col("item_id").alias("i"), F.struct("byte_count", "media_type", F.md5(part.cast("binary")).alias("sha256"), path.alias("relative_path")).alias("iv"))
    kinds = items.select(F.col("item_id").alias("k"), "media_type").join(library.select(F.col("id").alias("c"), "source_type").distinct(), F.col("k") == F.col("c"), "left")
    kinds = kinds.select("k", F.when(F.col("source_type") == "pdf", "application/pdf").otherwise(F.col("media_type")).alias("media_type"))
    a = artifacts.filter("kind = 'original'").join(kinds, F.col("item_id") == F.col("k"), "left").select(F.col("item_id").alias("a"), F.struct("byte_count", "media_type", "sha256", "relative_path").alias("av"))
    verdict = F.when(F.col("a").isNull(), "missing").when(F.col("i").isNull(), "extra").when(F.col("iv") != F.col("av"), "mismatch").otherwise("same")
    return i.join(a, F.col("i") == F.col("a"), "full_outer").select(F.coalesce("i", "a").alias("item_id"), verdict.alias("verdict"))


@query(
    """SELECT 'duplicate-item' AS rule, count(*) AS violations FROM (SELECT id FROM context_items GROUP BY id HAVING count(*) > 1)
       UNION ALL SELECT 'orphan-reference', count(*) FROM artifact_references r WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.id = r.artifact_id)
       UNION ALL SELECT 'failed-run-without-code', count(*) FROM runs WHERE (status = 'failed') <> (error_code IS NOT NULL)
       UNION ALL SELECT 'duplicate-path', count(*) FROM (SELECT relative_path FROM artifacts GROUP BY relative_path HAVING count(*) > 1)
       UNION ALL SELECT 'duplicate-place', count(*) FROM (SELECT pack_id, import_id, sort_index FROM context_items GROUP BY ALL HAVING count(*) > 1)
       UNION ALL SELECT 'second-original', count(*) FROM (SELECT item_id FROM artifacts WHERE kind = 'original' GROUP BY item_id HAVING count(*) > 1)
       UNION ALL SELECT 'two-active-runs', count(*) FROM (SELECT pack_id, stage FROM runs WHERE status IN ('queued', 'running') GROUP BY ALL HAVING count(*) > 1)
       UNION ALL SELECT 'orphan-item', count(*) FROM context_items c WHERE NOT EXISTS (SELECT 1 FROM packs p WHERE p.id = c.pack_id)
       UNION ALL SELECT 'unknown-state', count(*) FROM context_items WHERE state NOT IN ('received', 'imported', 'extracted', 'analyzed', 'review-required', 'reviewed', 'packaged', 'recovering', 'failed', 'cancelled')
       UNION ALL SELECT 'negative-size', count(*) FROM artifacts WHERE byte_count < 0
       UNION ALL SELECT 'claim-without-deadline', count(*) FROM runs WHERE status = 'running' AND (session_id IS NULL) <> (deadline_ms IS NULL)""",
    "context_items", "artifact_references", "artifacts", "runs", "packs",
)
def constraints(library: DataFrame, references: DataFrame, artifacts: DataFrame, runs: DataFrame, packs: DataFrame) -> DataFrame:
    """Keys, partial keys, foreign keys and checks as counts of violations."""
    twice = lambda table, *key: table.groupBy(*key).count().filter("count > 1")
    lacks = lambda table, column, other, key: table.join(other.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
    bad = {
        "duplicate-item": twice(library, "id"),
        "orphan-reference": lacks(references, "artifact_id", artifacts, "id"),
        "failed-run-without-code": runs.filter((F.col("status") == "failed") != F.col("error_code").isNotNull()),
        "duplicate-path": twice(artifacts, "relative_path"),
        "duplicate-place": twice(library, "pack_id", "import_id", "sort_index"),
        "second-original": twice(artifacts.filter("kind = 'original'"), "item_id"),
        "two-active-runs": twice(runs.filter(F.col("status").isin("queued", "running")), "pack_id", "stage"),
        "orphan-item": lacks(library, "pack_id", packs, "id"),
        "unknown-state": library.filter(~F.col("state").isin(*ITEM_STATES)),
        "negative-size": artifacts.filter("byte_count < 0"),
        "claim-without-deadline": runs.filter((F.col("status") == "running") & (F.col("session_id").isNull() != F.col("deadline_ms").isNull())),
    }
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in bad.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# Read models.

_WORKING = "'received', 'imported', 'extracted', 'analyzed', 'reviewed', 'recovering'"
_COUNTS = f"count(c.id) AS total, count(CASE WHEN c.state = 'packaged' THEN 1 END) AS complete, count(CASE WHEN c.state IN ({_WORKING}) THEN 1 END) AS processing, count(CASE WHEN c.state = 'review-required' THEN 1 END) AS review_required, count(CASE WHEN c.state = 'failed' THEN 1 END) AS failed, count(CASE WHEN c.state = 'cancelled' THEN 1 END) AS cancelled"


def _completeness(library: DataFrame) -> DataFrame:
    of = lambda *states: F.count_if(F.col("state").isin(*states))
    return library.groupBy("pack_id").agg(
        F.count("*").alias("total"), of("packaged").alias("complete"), of("received", "imported", "extracted", "analyzed", "reviewed", "recovering").alias("processing"),
        of("review-required").alias("review_required"), of("failed").alias("failed"), of("cancelled").alias("cancelled"),
    )


@query(f"SELECT c.pack_id, {_COUNTS} FROM context_items c GROUP BY c.pack_id", "context_items")
def completeness(library: DataFrame) -> DataFrame:
    return _completeness(library)


@query(
    f"""SELECT p.id, CASE WHEN p.state IN ('exporting', 'recovering') THEN 'processing' ELSE p.state END AS section, p.updated_at, n.total, p.warnings + n.review_required + n.failed AS warning_count
        FROM packs p JOIN (SELECT c.pack_id, {_COUNTS} FROM context_items c GROUP BY c.pack_id) n ON n.pack_id = p.id WHERE p.deleted_at IS NULL""",
    "packs", "context_items",
)
def sections(packs: DataFrame, library: DataFrame) -> DataFrame:
    section = F.when(F.col("state").isin("exporting", "recovering"), "processing").otherwise(F.col("state"))
    rows = packs.filter("deleted_at is null").select("id", section.alias("section"), "updated_at", "warnings").join(_completeness(library), F.col("id") == F.col("pack_id"))
    return rows.select("id", "section", "updated_at", "total", (F.col("warnings") + F.col("review_required") + F.col("failed")).alias("warning_count"))


@query("SELECT import_id, count(*) AS items, CAST(sum(byte_count) AS BIGINT) AS bytes, count(CASE WHEN lower(media_type) LIKE 'image/%' THEN 1 END) AS images, count(CASE WHEN media_type = 'application/pdf' THEN 1 END) AS pdfs, bool_and(status = 'copied') AS all_copied FROM import_items GROUP BY import_id", "import_items")
def import_batch_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("import_id").agg(F.count("*").alias("items"), F.sum("byte_count").alias("bytes"), F.count_if(F.lower("media_type").like("image/%")).alias("images"), F.count_if(F.col("media_type") == "application/pdf").alias("pdfs"), F.bool_and(F.col("status") == "copied").alias("all_copied"))


@query("SELECT item_id, string_agg(id, ',' ORDER BY created_at, id) AS artifacts, arg_max(id, created_at || id) AS latest FROM artifacts GROUP BY item_id", "artifacts")
def artifacts_by_item(artifacts: DataFrame) -> DataFrame:
    order = F.struct("created_at", "id")
    own = artifacts.groupBy("item_id").agg(F.array_sort(F.collect_list(order)).alias("a"), F.max(order).alias("l"))
    return own.select("item_id", F.array_join(F.transform("a", lambda x: x["id"]), ",").alias("artifacts"), F.col("l.id").alias("latest"))


@query("SELECT m.pack_id, arg_max(i.error_code, m.created_at || lpad(CAST(m.import_id AS VARCHAR), 12, '0') || i.item_id) AS error_code, count(*) AS errors FROM import_items i JOIN imports m ON m.import_id = i.import_id WHERE i.error_code IS NOT NULL GROUP BY m.pack_id", "import_items", "imports")
def first_error(items: DataFrame, imports: DataFrame) -> DataFrame:
    """The error of each pack's newest import that has one."""
    rows = items.filter("error_code is not null").select("import_id", "item_id", "error_code").join(imports.select("import_id", "pack_id", "created_at"), "import_id")
    return rows.groupBy("pack_id").agg(F.max_by("error_code", F.struct("created_at", "import_id", "item_id")).alias("error_code"), F.count("*").alias("errors"))


@query("SELECT m.pack_id, i.item_id, CAST(floor((row_number() OVER (PARTITION BY m.pack_id ORDER BY i.import_id, i.sort_index, i.item_id) - 1) / 20) AS BIGINT) AS batch FROM import_items i JOIN imports m ON m.import_id = i.import_id WHERE i.status = 'failed'", "import_items", "imports")
def retry_batches(items: DataFrame, imports: DataFrame, size: int = 20) -> DataFrame:
    """A pack's failed items in drafts of 20 at most."""
    rows = items.filter("status = 'failed'").join(imports.select("import_id", "pack_id"), "import_id")
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("import_id", "sort_index", "item_id")) - 1
    return rows.select("pack_id", "item_id", F.floor(place / size).alias("batch"))


@query("SELECT id, pack_id, row_number() OVER (PARTITION BY pack_id ORDER BY CASE WHEN moved THEN 1.5 ELSE place END, place) - 1 AS sort_index FROM (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY import_id, sort_index, id) AS place, row_number() OVER (PARTITION BY pack_id ORDER BY import_id DESC, sort_index DESC, id DESC) = 1 AS moved FROM context_items)", "context_items")
def reorder(library: DataFrame) -> DataFrame:
    """Each pack's last item moved to the second place, and places numbered anew without gaps."""
    by = Window.partitionBy("pack_id").orderBy("import_id", "sort_index", "id")
    rows = library.select("id", "pack_id", F.row_number().over(by).alias("place"), F.lead("id").over(by).isNull().alias("moved"))
    key = F.when(F.col("moved"), 1.5).otherwise(F.col("place"))
    return rows.select("id", "pack_id", (F.row_number().over(Window.partitionBy("pack_id").orderBy(key, "place")) - 1).cast("long").alias("sort_index"))
