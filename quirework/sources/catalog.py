"""The tables of a document library, as views over the star schema at hand.

Each view is one SELECT that Spark and other engines read alike; braces hold the names of the tables it reads. `load`
gives a view as a DataFrame, `ctes` as common table expressions for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The states that an item can be in.
ITEM_STATES = ("received", "imported", "extracted", "analyzed", "review-required", "reviewed", "packaged", "recovering", "failed", "cancelled")
PACK_STATES = ("draft", "processing", "review-required", "ready", "exporting", "exported", "failed", "cancelled", "recovering")


def _choose(number: str, values: tuple[str, ...]) -> str:
    return f"CASE CAST({number} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_ITEM = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
_DAY = "CAST(CAST({0} AS DATE) AS STRING) || 'T00:00:00Z'"

VIEWS: dict[str, str] = {
    "imports": f"""
        SELECT o_orderkey AS import_id, o_custkey AS pack_id, {_DAY.format("o_orderdate")} AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, o_orderpriority AS source
        FROM {{orders}}""",
    "import_items": f"""
        SELECT l_orderkey AS import_id, {_ITEM} AS item_id, CAST(l_linenumber AS BIGINT) AS sort_index,
               {_choose("l_partkey", ("image/png", "application/pdf", "text/uri-list", "TEXT/plain", "IMAGE/JPEG"))} AS media_type,
               CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'copied' END AS status,
               CASE WHEN l_returnflag = 'R' THEN {_choose("l_suppkey", ("INPUT_READ_FAILED", "INPUT_TOO_LARGE", "INPUT_TYPE_UNSUPPORTED"))} END AS error_code,
               CAST(l_quantity * 1000 AS BIGINT) AS byte_count, CAST(l_suppkey AS BIGINT) AS supplier
        FROM {{lineitem}}""",
    "context_items": f"""
        SELECT {_ITEM} AS id, o_custkey AS pack_id, l_orderkey AS import_id, {_choose("l_suppkey", ITEM_STATES)} AS state,
               {_choose("l_partkey", ("image", "pdf", "url", "text", "image"))} AS source_type,
               {_choose("l_partkey + l_suppkey", ("both", "original", "extracted", "excluded"))} AS inclusion_mode,
               CASE WHEN l_returnflag <> 'R' THEN md5(CAST(l_partkey AS STRING)) END AS original_sha256,
               CAST(l_linenumber AS BIGINT) AS sort_index, {_DAY.format("o_orderdate")} AS created_at, CAST(l_quantity * 1000 AS BIGINT) AS byte_count
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        WHERE (l_returnflag <> 'R' OR l_quantity > 40) AND NOT (l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount >= 0.1)""",
    "artifacts": f"""
        SELECT {_ITEM} || '/o' AS id, {_ITEM} AS item_id, 'original' AS kind, 'Packs/' || CAST(l_orderkey AS STRING) || '/Originals/' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS relative_path,
               CAST(l_quantity * 1000 AS BIGINT) AS byte_count, md5(CAST(l_partkey AS STRING)) AS sha256, {_DAY.format("l_shipdate")} AS created_at
        FROM {{lineitem}} WHERE l_returnflag <> 'R' OR l_quantity > 40
        UNION ALL
        SELECT {_ITEM} || '/e', {_ITEM}, {_choose("l_partkey", ("ocr-text", "pdf-page-text", "normalized-text"))}, 'Packs/' || CAST(l_orderkey AS STRING) || '/Derived/' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING),
               CAST(l_quantity * 100 AS BIGINT), md5(CAST(l_partkey AS STRING) || 'e'), {_DAY.format("l_shipdate")}
        FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag <> 'R'""",
    "artifact_references": f"""
        SELECT 'context-item' AS owner_type, {_ITEM} AS owner_id, {_ITEM} || '/o' AS artifact_id FROM {{lineitem}} WHERE (l_returnflag <> 'R' OR l_quantity > 40) AND l_tax > 0.03
        UNION ALL
        SELECT 'export', CAST(l_orderkey AS STRING), {_ITEM} || '/e' FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag <> 'R' AND l_discount > 0.05""",
    "packs": f"""
        SELECT c_custkey AS id, c_name AS title, {_choose("c_custkey", PACK_STATES)} AS state,
               '2024-01-' || lpad(CAST(1 + c_nationkey AS STRING), 2, '0') || 'T00:00:00Z' AS updated_at,
               CASE WHEN c_acctbal < 0 THEN '2024-03-01T00:00:00Z' END AS deleted_at, c_custkey % 4 AS warnings, c_custkey % 3 AS revision
        FROM {{customer}}""",
    "runs": f"""
        SELECT event_id AS id, user_id AS pack_id, {_choose("event_id", ("import", "extract", "analyze", "review", "package"))} AS stage,
               CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'recovering' END AS status,
               event_id % 4 AS claim_version, 'session-' || CAST(user_id % 3 AS STRING) AS session_id, CAST(round(value * 1000) AS BIGINT) AS deadline_ms,
               CASE WHEN event_type = 'error' THEN {_choose("event_id", ("RESOURCE_MEMORY_PRESSURE", "TEXT_TOO_LARGE", "OCR_FAILED"))} END AS error_code
        FROM {{events}}""",
    "run_items": f"""
        SELECT event_id AS id, event_id % 1000 AS import_id, user_id AS pack_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'recovering' END AS status,
               {_choose("event_id", ("import", "extract", "analyze", "review", "package"))} AS stage, CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00Z' AS updated_at, event_id % 4 AS claim_version,
               CASE WHEN event_type = 'click' THEN 'session-' || CAST(user_id % 3 AS STRING) END AS session_id, CASE WHEN event_type = 'click' THEN CAST(round(value * 1000) AS BIGINT) END AS deadline_ms
        FROM {{events}}""",
    "journal": f"""
        SELECT o_orderkey AS ingestion_id, o_custkey AS pack_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'discovered' WHEN '2' THEN 'handoff-started' WHEN '3' THEN 'files-published' WHEN '4' THEN 'database-committed' ELSE 'quarantined' END AS phase,
               {_DAY.format("o_orderdate")} AS updated_at, CASE WHEN o_orderpriority LIKE '5%' THEN 'PIPELINE_RECOVERY_REQUIRED' END AS error_code
        FROM {{orders}}""",
    "risk_findings": f"""
        SELECT {_ITEM} || '/f' AS id, {_ITEM} AS item_id, {_choose("l_partkey", ("email", "phone", "api-key", "jwt"))} AS category, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS severity,
               l_discount * 10 AS confidence, {_DAY.format("l_shipdate")} AS created_at
        FROM {{lineitem}} WHERE l_discount >= 0.05""",
    "export_records": f"""
        SELECT o_orderkey AS id, o_custkey AS pack_id, CASE o_orderstatus WHEN 'F' THEN 'markdown' WHEN 'O' THEN 'pdf' ELSE 'clipboard' END AS format, {_DAY.format("o_orderdate")} AS created_at, 'complete' AS status
        FROM {{orders}} WHERE o_totalprice > 100000""",
    "export_artifacts": f"""
        SELECT l_orderkey AS export_id, {_ITEM} || '/e' AS artifact_id, CAST(l_linenumber AS BIGINT) AS sort_index
        FROM {{lineitem}} WHERE l_linestatus = 'F' AND l_returnflag <> 'R'""",
    "quarantine": """
        SELECT event_id AS id, user_id AS anonymous_id, CASE WHEN value > 100 THEN 'unknown-file' ELSE 'unreferenced' END AS reason, CAST(round(value * 100) AS BIGINT) AS byte_count, CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00Z' AS created_at,
               CASE WHEN value > 150 THEN '2024-12-01T00:00:00Z' END AS purged_at
        FROM {events} WHERE event_type = 'error'""",
    "stored_suggestions": f"""
        SELECT o_orderkey AS group_id, o_custkey AS pack_id, a.item AS left_id, b.item AS right_id, a.quantity AS bytes_saved
        FROM {{orders}} JOIN (SELECT l_orderkey, l_linenumber, {_ITEM} AS item, CAST(l_quantity * 1000 AS BIGINT) AS quantity FROM {{lineitem}}) a ON a.l_orderkey = o_orderkey
        JOIN (SELECT l_orderkey, l_linenumber, {_ITEM} AS item FROM {{lineitem}}) b ON b.l_orderkey = o_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "decisions": f"""
        SELECT {_ITEM} AS item_id, o_custkey AS pack_id, CASE WHEN l_tax > 0.06 THEN 'exclude' WHEN l_tax > 0.05 THEN 'preferred' ELSE 'keep' END AS choice,
               {_choose("l_partkey + l_suppkey", ("both", "original", "extracted", "excluded"))} AS baseline, CASE WHEN l_discount > 0.05 THEN 'preferred-group' ELSE 'standalone' END AS source, {_DAY.format("l_shipdate")} AS decided_at
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_tax > 0.03""",
    "file_artifacts": """
        SELECT doc_id AS id, coalesce(lang, 'und') AS kind, 'Packs/' || CAST(doc_id AS STRING) || '/originals/text.txt' AS relative_path, text FROM {documents}""",
    "file_store": """
        SELECT 'Packs/' || CAST(doc_id AS STRING) || '/originals/text.txt' AS path, CASE WHEN quality = 0 AND toxic = 0 THEN text || '!' ELSE text END AS content
        FROM {documents} LEFT JOIN (SELECT doc_id AS l_id, min(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l ON l_id = doc_id WHERE coalesce(toxic, 0) = 0
        UNION ALL SELECT 'Quarantine/' || CAST(item_id AS STRING), text FROM {benchmark}""",
}


def tables(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", VIEWS[name]))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or else the table of that name; only columns that a plan uses are read."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(name)})


def ctes(*names: str) -> str:
    """WITH clause of these views."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names) + "\n"
