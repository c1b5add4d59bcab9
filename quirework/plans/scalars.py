"""Queries over texts, addresses, media types, pages, states, events and findings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import normalize as N
from quirework.functions import text as T
from quirework.functions import urls as U
from quirework.operators import contracts as C
from quirework.operators import images, pages, privacy, states
from quirework.operators import records as R
from quirework.operators.contracts import MANIFEST, decode, error_catalog, valid_manifest
from quirework.plans.relational import ORACLE_SQL as _ORACLE
from quirework.plans.relational import QUERIES as _QUERIES
from quirework.plans.relational import query as _register
from quirework.storage import shared_dir
from quirework.streaming import events as E


def query(sql: str, *views: str):
    """As query of the relational plans, but registered here."""

    def add(plan):
        _register(sql, *views)(plan)
        QUERIES[plan.__name__] = _QUERIES.pop(plan.__name__)
        own = _ORACLE.pop(plan.__name__)
        if sql:
            ORACLE_SQL[plan.__name__] = own
        return plan

    return add


QUERIES: dict = {}
ORACLE_SQL: dict = {}

_U, _B = T.UNSAFE, T.BLANK
_DIRTY = "CASE doc_id % 6 WHEN 0 THEN '﻿' || text WHEN 1 THEN replace(text, '\n', '\r\n') WHEN 2 THEN text || '\x07' WHEN 3 THEN text || '\r' || '\U0001f600' ELSE text END"
_UTF16 = "CAST(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT)"


def _dirty():
    """Some documents get a byte order mark, other line ends, a control or an emoji."""
    k = F.col("doc_id") % 6
    return F.when(k == 0, F.concat(F.lit("﻿"), "text")).when(k == 1, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.concat("text", F.lit("\x07"))).when(k == 3, F.concat("text", F.lit("\r\U0001f600"))).otherwise(F.col("text"))


@query(
    f"""SELECT doc_id, CASE WHEN ok THEN md5(c) END AS text_md5, CASE WHEN ok THEN CAST(strlen(d) AS BIGINT) END AS byte_count, CASE WHEN ok THEN {_UTF16.format("c")} END AS character_count,
          CASE WHEN ok THEN concat_ws(',', CASE WHEN d LIKE '﻿%' THEN 'TEXT_BOM_REMOVED' END, CASE WHEN contains(d, '\r') THEN 'TEXT_LINE_ENDINGS_NORMALIZED' END, CASE WHEN regexp_matches(d, '[{_U}]') THEN 'TEXT_UNSAFE_CONTROL_REPLACED' END) END AS warnings,
          CASE WHEN strlen(d) > {T.MAX_PLAIN_BYTES} THEN 'TEXT_TOO_LARGE' WHEN d IS NULL THEN 'TEXT_INVALID_UTF8' END AS error_code
        FROM (SELECT *, coalesce(strlen(d) <= {T.MAX_PLAIN_BYTES}, false) AS ok, regexp_replace(regexp_replace(regexp_replace(d, '^﻿', ''), '\\r\\n?', '\n', 'g'), '[{_U}]', '�', 'g') AS c FROM (SELECT doc_id, {_DIRTY} AS d FROM documents))""",
    "documents",
)
def plain_text_clean(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", T.plain_text(_dirty()).alias("p"))
    return rows.select("doc_id", F.md5(F.col("p.text").cast("binary")).alias("text_md5"), "p.byte_count", "p.character_count", F.array_join("p.warnings", ",").alias("warnings"), "p.error_code")


@query(f"SELECT doc_id, CAST(strlen(d) AS BIGINT) AS utf8_bytes, {_UTF16.format('d')} AS utf16_units, CAST(length(regexp_replace(d, '[{T.DENSITY_BLANK}]', '', 'g')) + len(regexp_extract_all(d, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS BIGINT) AS density FROM (SELECT doc_id, {_DIRTY} AS d FROM documents)", "documents")
def text_lengths(docs: DataFrame) -> DataFrame:
    d = _dirty()
    return docs.select("doc_id", T.utf8_bytes(d).alias("utf8_bytes"), T.utf16_units(d).alias("utf16_units"), T.density(d).alias("density"))


@query(f"SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', '\n', 'g'), '\n'), lambda x: regexp_replace(regexp_replace(x, '[\t ]+', ' ', 'g'), '^[{_B}]+|[{_B}]+$', '', 'g')), '\n'), '\\n{{3,}}', '\n\n', 'g')) AS text_md5 FROM (SELECT doc_id, replace(text, '. ', '.\t \n\n \n') AS text FROM documents)", "documents")
def line_normalize(docs: DataFrame) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\t \n\n \n"))
    return docs.select("doc_id", F.md5(T.collapse_lines(text).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, 'en ', E'e-\\nn '), '-\\n(\\p{Ll})', '\\1', 'g')) AS text_md5 FROM documents", "documents")
def wrapped_join(docs: DataFrame) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("en "), F.lit("e-\nn "))
    return docs.select("doc_id", F.md5(T.rejoin_words(text).cast("binary")).alias("text_md5"))


@query("", "documents")
def content_normalized(docs: DataFrame) -> DataFrame:
    """The whole normalisation, which NFKC and the fold over fences keep from SQL; tests hold it against cases."""
    return docs.select("doc_id", N.normalized(_dirty()).alias("n")).select("doc_id", "n.kind", "n.byte_count", "n.character_count", F.array_join("n.warnings", ",").alias("warnings"), "n.error_code", F.md5(F.col("n.text").cast("binary")).alias("text_md5"))


@query(
    """SELECT page_id, scheme, host, path, scheme || '://' || CASE WHEN page_id % 5 = 0 THEN '[REDACTED]@' ELSE '' END || host || path
         || CASE WHEN q <> '' THEN '?' || array_to_string(list_transform(string_split(q, '&'), lambda p: CASE WHEN contains(p, '=') THEN url_encode(split_part(p, '=', 1)) || '=[REDACTED]' ELSE '[REDACTED]' END), '&') ELSE '' END
         || CASE WHEN f <> '' THEN '#[REDACTED]' ELSE '' END AS display,
         concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'URL_CREDENTIAL_REDACTED' END, CASE WHEN q <> '' THEN 'URL_QUERY_VALUES_REDACTED' END, CASE WHEN f <> '' THEN 'URL_FRAGMENT_REDACTED' END) AS warnings
       FROM (SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
                    regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages)""",
    "pages",
)
def url_extract(rows: DataFrame) -> DataFrame:
    """Every fifth address gets credentials."""
    url = F.when(F.col("page_id") % 5 == 0, F.replace(F.col("url"), F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url"))
    return rows.select("page_id", U.extract_url(url).alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.display", F.array_join("u.warnings", ",").alias("warnings"))


@query(
    """SELECT item_id, lower(media_type) AS media_type, CASE WHEN lower(media_type) LIKE 'image/%' THEN 'image' WHEN lower(media_type) = 'application/pdf' THEN 'pdf' WHEN lower(media_type) = 'text/uri-list' THEN 'url' ELSE 'text' END AS source_type,
         CASE WHEN byte_count * 2000 > CASE WHEN lower(media_type) IN ('text/plain', 'text/uri-list') THEN 1048576 ELSE 52428800 END THEN 'IMPORT_SIZE_LIMIT_EXCEEDED' END AS error_code,
         CASE WHEN lower(media_type) = 'text/uri-list' THEN 'URL ' WHEN lower(media_type) = 'text/plain' THEN 'Text ' WHEN lower(media_type) LIKE 'image/%' THEN 'Photo ' ELSE 'File ' END || CAST(sort_index AS VARCHAR) AS label
       FROM import_items""",
    "import_items",
)
def media_types(items: DataFrame) -> DataFrame:
    kind = U.source_type(F.col("media_type"))
    return items.select("item_id", U.bounded_media_type(F.col("media_type")).alias("media_type"), kind.alias("source_type"), U.preflight(F.col("media_type"), F.col("byte_count") * 2000).alias("error_code"), U.label(kind, F.col("sort_index")).alias("label"))


def _uuid(kind: str) -> str:
    """SQL of either dialect: a name-based identifier of a document."""
    h = f"md5('{kind}' || CAST(doc_id AS STRING))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    f"""SELECT doc_id, path, CASE WHEN doc_id % 3 <> 0 THEN split_part(path, '/', 2) END AS pack_id, CASE WHEN doc_id % 3 <> 0 THEN split_part(split_part(path, '/', 4), '.', 1) END AS artifact_id, doc_id % 3 <> 0 AS owned, doc_id % 3 <> 0 AS safe
        FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '../' ELSE '' END || 'Packs/' || {_uuid("pack")} || '/derived/' || {_uuid("artifact")} || '.txt' AS path FROM documents)""",
    "documents",
)
def owned_paths(docs: DataFrame) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "../").otherwise(""), U.owned_path(F.expr(_uuid("pack")), F.lit("derived"), F.expr(_uuid("artifact")), F.lit("txt")))
    rows = docs.select("doc_id", path.alias("path")).withColumn("o", U.parse_owned_path(F.col("path")))
    return rows.select("doc_id", "path", "o.pack_id", "o.artifact_id", F.col("o").isNotNull().alias("owned"), U.is_safe_path(F.col("path")).alias("safe"))


_SNIFFED = "image/png", "image/jpeg", "image/gif", "application/pdf", "text/uri-list", "text/plain"
_HEADS = "89504E470D0A1A0A", "FFD8FFE0", "474946383961", "255044462D312E37", "68747470733A2F2F612E622F63"


@query("SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_SNIFFED)) + " END AS found, doc_id % 6 IN (0, 1, 2) AS as_image FROM documents WHERE text IS NOT NULL AND text <> ''", "documents")
def sniffed_types(docs: DataFrame) -> DataFrame:
    content = F.col("text").cast("binary")
    for i, head in enumerate(_HEADS):
        content = F.when(F.col("doc_id") % 6 == i, F.unhex(F.lit(head))).otherwise(content)
    rows = docs.filter("text <> ''").select("doc_id", U.sniffed_type(content).alias("found"))
    return rows.select("doc_id", "found", U.compatible(F.lit("image/*"), F.col("found")).alias("as_image"))


@query(
    """SELECT conv_id AS key, count(*) AS pages, string_agg(CASE WHEN failed THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS failed_pages, CASE WHEN bool_or(failed) THEN 'partial' ELSE 'ready' END AS status,
         CASE WHEN NOT bool_or(failed) THEN md5(string_agg(text, E'\\n\\n' ORDER BY turn)) END AS text_md5 FROM (SELECT *, (conv_id * 7 + turn) % 11 = 3 AS failed FROM conversations) GROUP BY conv_id""",
    "conversations",
)
def pdf_rollup(turns: DataFrame) -> DataFrame:
    """Conversations as documents, turns as pages, some of which failed."""
    rows = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("page"), F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 == 3, "failed").otherwise("complete").alias("status"), "text")
    found = pages.document_text(rows)
    return found.select("key", "pages", F.nullif(F.array_join(F.transform("failed_pages", lambda p: p.cast("string")), ","), F.lit("")).alias("failed_pages"), "status", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_OWN = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN ' ' || source ELSE text END"
_SEEN = "CASE WHEN doc_id % 3 = 0 THEN ' ' || source ELSE text END"
_BARE = lambda c: f"length(regexp_replace({c}, '[{T.DENSITY_BLANK}]', '', 'g'))"


@query(
    f"""SELECT doc_id, CASE WHEN {_BARE("own")} >= 16 THEN 'embedded-text' ELSE 'ocr' END AS method, md5(CASE WHEN {_BARE("own")} >= 16 THEN own WHEN {_BARE("own")} = 0 THEN seen WHEN {_BARE("seen")} = 0 OR own = seen THEN own ELSE own || E'\\n' || seen END) AS text_md5,
          concat_ws(',', CASE WHEN {_BARE("own")} BETWEEN 1 AND 15 THEN 'PDF_EMBEDDED_TEXT_SPARSE' END, CASE WHEN {_BARE("own")} < 16 THEN 'PDF_PAGE_OCR_FALLBACK' END, CASE WHEN {_BARE("own")} < 16 AND {_BARE("own")} + {_BARE("seen")} = 0 THEN 'PDF_PAGE_EMPTY' END) AS warnings, 'complete' AS status
        FROM (SELECT doc_id, {_OWN} AS own, {_SEEN} AS seen FROM documents)""",
    "documents",
)
def page_methods(docs: DataFrame) -> DataFrame:
    """Documents as pages: their text is embedded, or not, or a few characters alone are; and all or a little of it is recognised."""
    rows = docs.select("doc_id", pages.page_result(F.expr(_OWN), F.expr(_SEEN), F.expr("cast(array() as array<struct<text:string>>)")).alias("p"))
    return rows.select("doc_id", "p.method", F.md5(F.col("p.text").cast("binary")).alias("text_md5"), F.array_join("p.warnings", ",").alias("warnings"), "p.status")


@query(
    """WITH RECURSIVE placed AS (SELECT vec_id, CAST(i AS VARCHAR) AS text, abs(CAST(embedding[2 * i + 1] AS DOUBLE)) AS x, abs(CAST(embedding[2 * i + 2] AS DOUBLE)) AS y FROM embeddings, range(8) r(i)),
    listed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y, x, text) AS n FROM placed),
    walk AS (SELECT vec_id, n, text, x, y, y AS anchor, 1 AS line FROM listed WHERE n = 1
      UNION ALL SELECT l.vec_id, l.n, l.text, l.x, l.y, CASE WHEN l.y - w.anchor >= 0.01 THEN l.y ELSE w.anchor END, w.line + CASE WHEN l.y - w.anchor >= 0.01 THEN 1 ELSE 0 END FROM walk w JOIN listed l ON l.vec_id = w.vec_id AND l.n = w.n + 1)
    SELECT vec_id, string_agg(text, E'\\n' ORDER BY line, x, y, text) AS text FROM walk GROUP BY vec_id""",
    "embeddings",
)
def reading_order(vectors: DataFrame) -> DataFrame:
    """Eight blocks a vector, their places from its components."""
    block = lambda i: F.struct(i.cast("string").alias("text"), F.abs(F.get("embedding", i * 2)).cast("double").alias("x"), F.abs(F.get("embedding", i * 2 + 1)).cast("double").alias("y"), F.lit(0.1).alias("width"), F.lit(0.01).alias("height"))
    rows = vectors.select("vec_id", pages.reading_order(F.transform(F.sequence(F.lit(0), F.lit(7)), block)).alias("b"))
    return rows.select("vec_id", pages.block_text(F.col("b")).alias("text"))


@query("SELECT vec_id, lpad(printf('%x', list_sum(list_transform(range(64), lambda i: CASE WHEN u[i // 8 * 9 + i % 8 + 1] > u[i // 8 * 9 + i % 8 + 2] THEN CAST(1 AS UBIGINT) << CAST(63 - i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END))::UBIGINT), 16, '0') AS hash FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS u FROM embeddings)", "embeddings")
def grid_hash(vectors: DataFrame) -> DataFrame:
    """A hash of 72 numbers for each vector: its 64 components and the first eight again."""
    return vectors.select("vec_id", images.grid_hash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("hash"))


_COMMANDS = [m[0] for m in states.PACK_MOVES]


_MOVES = ", ".join(f"('{c}', '{f}', '{t}')" for c, t, sources in states.PACK_MOVES for f in sources)


@query(
    f"""WITH RECURSIVE moves(command, source, target) AS (VALUES {_MOVES}),
    listed AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, [{", ".join(repr(c) for c in _COMMANDS)}][event_id % {len(_COMMANDS)} + 1] AS command FROM events),
    walk AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS place, 'draft' AS state, CAST(0 AS BIGINT) AS rejected FROM listed
      UNION ALL SELECT w.key, l.place, coalesce(m.target, w.state), w.rejected + CASE WHEN m.target IS NULL THEN 1 ELSE 0 END FROM walk w JOIN listed l ON l.key = w.key AND l.place = w.place + 1 LEFT JOIN moves m ON m.command = l.command AND m.source = w.state)
    SELECT key, arg_max(state, place) AS state, max(rejected) AS rejected, max(place) AS commands FROM walk GROUP BY key""",
    "events",
)
def state_replay(events: DataFrame) -> DataFrame:
    """Each user's events as commands to a pack."""
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))
    return states.replay(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), command.alias("command")), states.PACK_MOVES, "draft")


_CASE = lambda of, table, kind="": " ".join(f"WHEN {of} = '{k}' THEN {v!r}" for k, v in table.items())


@query(
    f"""SELECT id, state, CASE {_CASE("state", states.STAGE_OF)} ELSE retry END AS stage, CAST(CASE {_CASE("state", states.PROGRESS_OF)} ELSE CASE {_CASE("retry", states.PROGRESS_AT)} END END AS BIGINT) AS progress
        FROM (SELECT id, state, CASE WHEN original_sha256 IS NULL THEN 'import' WHEN source_type <> 'pdf' THEN 'extract' ELSE 'analyze' END AS retry FROM context_items)""",
    "context_items",
)
def item_progress(library: DataFrame) -> DataFrame:
    retry = states.retry_stage(F.lit(None).cast("string"), F.col("original_sha256").isNotNull(), F.col("source_type") == "pdf", F.lit(False), F.col("state"))
    return library.select("id", "state", states.stage_and_progress(F.col("state"), retry).alias("s")).select("id", "state", "s.stage", "s.progress")


@query("SELECT user_id || ':' || event_type AS id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1", "events")
def event_dedup(events: DataFrame) -> DataFrame:
    """Of the events of a user and kind, which share an id, the first."""
    rows = events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), "ts", "event_id")
    return E.first_events(rows, "ts", "event_id").select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id")


def _deliver(lines: DataFrame, folder: str, batch, read=lambda inbox: inbox) -> None:
    """Add lines (value) to the inbox in folder and have a stream give what is new there, as read makes it, to batch."""
    lines.write.mode("append").text(f"{folder}/inbox")
    inbox = read(lines.sparkSession.readStream.schema("value string").text(f"{folder}/inbox"))
    stream = inbox.writeStream.foreachBatch(batch).trigger(availableNow=True)
    stream.option("checkpointLocation", f"{folder}/offsets").start().awaitTermination()


def _share_id() -> str:
    """SQL of either dialect: an identifier that a user's events of one kind share."""
    h = "md5('share' || CAST(user_id AS STRING) || ':' || event_type)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    f"""SELECT DISTINCT {_share_id()} AS id, CASE event_type WHEN 'error' THEN 'blockers' ELSE 'scans' END AS routed_to, event_type <> 'error' AS durable FROM events WHERE event_id % 11 <> 0
        UNION ALL SELECT DISTINCT {_share_id()}, 'rejected', NULL FROM events WHERE event_id % 11 = 0""",
    "events",
)
def event_routing(events: DataFrame) -> DataFrame:
    """Events as share events in an inbox that a stream routes; errors are delivered again after what was acknowledged, some events are of another version.

    Rows are what the stream's tables hold, rejected identifiers once each.
    """
    spark, error = events.sparkSession, F.col("event_type") == "error"
    share = F.struct(
        F.when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("schemaVersion"),
        F.expr(_share_id()).alias("id"),
        F.when(error, "failed").otherwise("complete").alias("result"),
        F.when(error, F.lit(False)).alias("durable"),
        F.when(error, "SHARE_IMPORT_FAILED").alias("code"),
    )
    folder = f"{shared_dir(spark)}/routing-{uuid.uuid4().hex}"
    for delivered in (events.filter("event_type <> 'purchase'"), events.filter("event_type in ('purchase', 'error')")):
        _deliver(delivered.select(F.to_json(share).alias("value")), folder, E.route_events(f"{folder}/out"))
    table = lambda name: E.table_at(spark, f"{folder}/out/{name}", "id string, durable boolean, value string")
    routed = [table(name).select("id", F.lit(name).alias("routed_to"), "durable") for name in ("scans", "blockers")]
    acknowledged = table("acks").select(F.col("id").alias("a"))
    rejected = table("rejected").select(F.get_json_object("value", "$.id").alias("id"), F.lit("rejected").alias("routed_to"), F.lit(None).cast("boolean").alias("durable")).distinct()
    return routed[0].unionByName(routed[1]).join(acknowledged, F.col("id") == F.col("a")).drop("a").unionByName(rejected)


@query(
    """SELECT CAST(e.user_id AS VARCHAR) AS key, max(CASE WHEN event_type = 'error' AND (done IS NULL OR event_id > done) THEN 1 ELSE 0 END) = 1 AS blocked,
         arg_max(code, event_id) FILTER (WHERE event_type = 'error' AND (done IS NULL OR event_id > done)) AS latest,
         CAST(count(DISTINCT code) FILTER (WHERE event_type = 'error' AND (done IS NULL OR event_id > done)) AS INTEGER) AS codes
       FROM (SELECT *, 'SHARE_' || CAST(event_id % 3 AS VARCHAR) AS code, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS done FROM events WHERE event_type IN ('error', 'purchase')) e GROUP BY user_id""",
    "events",
)
def event_blockers(events: DataFrame) -> DataFrame:
    own = events.filter("event_type in ('error', 'purchase')")
    return E.blockers(own.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("result"), F.concat(F.lit("SHARE_"), (F.col("event_id") % 3).cast("string")).alias("code")))


@query(
    """WITH RECURSIVE listed AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, epoch_ms(ts) % 1000000000 AS ms, 's' || event_id % 2 AS session, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'claim' WHEN event_type = 'error' THEN 'renew' ELSE 'release' END AS action,
      row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) % 1000000000, event_id) AS place FROM events),
    walk AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS deadline, CAST(0 AS BIGINT) AS version, false AS granted FROM listed
      UNION ALL SELECT key, place, seq, CASE WHEN NOT granted THEN was WHEN action = 'release' THEN NULL ELSE session END, CASE WHEN granted AND action <> 'release' THEN ms + 300000 ELSE deadline END, version + CASE WHEN granted AND action = 'claim' THEN 1 ELSE 0 END, granted
        FROM (SELECT w.key, l.place, l.seq, l.action, l.session, l.ms, w.owner AS was, w.deadline, w.version, CASE WHEN l.action = 'claim' THEN w.owner IS NULL OR l.ms >= w.deadline ELSE coalesce(w.owner = l.session, false) AND l.ms < w.deadline END AS granted
              FROM walk w JOIN listed l ON l.key = w.key AND l.place = w.place + 1))
    SELECT key, seq, granted, version AS claim_version FROM walk WHERE place > 0""",
    "events",
)
def lease_expiry(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type").isin("view", "click", "signup"), "claim").when(F.col("event_type") == "error", "renew").otherwise("release")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) % 10**9).alias("at_ms"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("session"), action.alias("action"), F.lit(300_000).cast("long").alias("ttl_ms"))
    return E.leases(rows)


def _manifests(items: DataFrame, created_at: str = "2024-02-29T00:00:00.000Z") -> DataFrame:
    """import_id and a manifest of each import as JSON; some have another version or a status that isn't true."""
    name = lambda c: F.regexp_replace(F.md5(c.cast("binary")), r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", r"$1-$2-4$3-8$4-$5")
    one = F.struct("sort_index", "item_id", "media_type", "status", "byte_count")
    rows = items.groupBy("import_id").agg(F.array_sort(F.collect_list(one)).alias("i"))
    good = F.size(F.filter("i", lambda x: x["status"] == "copied"))
    status = F.when(good == F.size("i"), "complete").when(good > 0, "partial").otherwise("failed")
    item = lambda x, i: F.struct(name(x["item_id"]).alias("id"), i.alias("order"), x["media_type"].alias("mediaType"), x["status"].alias("status"), F.when(x["status"] == "copied", x["byte_count"]).otherwise(0).alias("byteCount"), F.when(x["status"] == "copied", F.concat(name(x["item_id"]), F.lit(".bin"))).alias("relativePath"), F.when(x["status"] == "failed", "IMPORT_COPY_FAILED").alias("errorCode"))
    made = F.struct(F.when(F.col("import_id") % 5 == 1, 2).otherwise(1).alias("schemaVersion"), name(F.col("import_id").cast("string")).alias("ingestionId"), F.lit(created_at).alias("createdAt"), F.lit("main-app-text").alias("source"), F.when(F.col("import_id") % 5 == 2, "unknown").otherwise(status).alias("status"), F.transform("i", item).alias("items"))
    return rows.select("import_id", F.to_json(made).alias("value"))


@query(
    """SELECT import_id, CASE WHEN import_id % 5 = 1 THEN 'SCHEMA_VERSION_UNSUPPORTED' WHEN import_id % 5 = 2 OR n > 128 OR n > ids THEN 'SCHEMA_INVALID' END AS error_code FROM (SELECT import_id, count(*) AS n, count(DISTINCT item_id) AS ids FROM import_items GROUP BY import_id)""",
    "import_items",
)
def manifest_valid(items: DataFrame) -> DataFrame:
    return _manifests(items).select("import_id", decode(F.col("value"), MANIFEST, valid_manifest)["error_code"].alias("error_code"))


@query(
    """SELECT regexp_replace(md5(CAST(import_id AS VARCHAR)), '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '\\1-\\2-4\\3-8\\4-\\5') AS ingestion_id, CAST(n AS INTEGER) AS items, CAST(CASE WHEN import_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS conflicts
       FROM (SELECT import_id, count(*) AS n, count(DISTINCT item_id) AS ids FROM import_items GROUP BY import_id) WHERE import_id % 5 NOT IN (1, 2) AND n <= 128 AND n = ids""",
    "import_items",
)
def import_commits(items: DataFrame) -> DataFrame:
    """Manifests that a stream commits; some come again as they were, others again with another instant, which is a conflict."""
    spark = items.sparkSession
    folder = f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}"
    fingerprint = F.sha2(F.col("value").cast("binary"), 256).alias("fingerprint")
    read = lambda inbox: inbox.select(fingerprint, decode(F.col("value"), MANIFEST, valid_manifest).alias("d")).select("fingerprint", "d.value", "d.error_code")
    again = _manifests(items.filter("import_id % 7 = 0"), "2024-03-01T00:00:00.000Z").unionByName(_manifests(items.filter("import_id % 7 = 1")))
    for delivered in (_manifests(items), again):
        _deliver(delivered.select("value"), folder, E.commit_imports(f"{folder}/out"), read)
    kinds = "ingestion_id string, fingerprint string, items int"
    told = E.table_at(spark, f"{folder}/out-conflicts", kinds).groupBy(F.col("ingestion_id").alias("c")).agg(F.count("*").alias("conflicts"))
    return E.table_at(spark, f"{folder}/out", kinds).join(told, F.col("ingestion_id") == F.col("c"), "left").select("ingestion_id", "items", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


_ID, _SHA, _AT = "11111111-2222-4333-8444-555555555555", "ab" * 32, "2024-02-29T12:00:00Z"
_PRINT = {"schemaVersion": 1, "algorithm": "bottom-k-fnv1a32-5gram-v1", "shingleSize": 5, "sampleSize": 128, "similarityCharacterCount": 6, "shingleCount": 2, "hashes": ["00000001", "0000000a"]}
_HASH = {"schemaVersion": 1, "algorithm": "dhash-64-v1", "hash": "0" * 16, "sampleWidth": 9, "sampleHeight": 8, "orientationApplied": True, "durationMs": 1.5, "revision": "1"}
_BLOCK = {"text": "seen", "bounds": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.1}, "confidence": 0.9}
#: Of each kind of record a valid one, and a change that makes it invalid.
RECORDS = {
    "capabilities": (R.CAPABILITIES, R.valid_capabilities, {"schemaVersion": 1, "engines": [{"engine": "ml-kit-latin", "revision": "1", "scripts": ["latin"], "recognitionLevels": ["fast"], "ready": True, "offline": True}], "maximumPixelCount": 9, "maximumDimension": 9}, {"maximumDimension": 0}),
    "page": (R.PAGE, R.valid_page, {"schemaVersion": 1, "pageIndex": 0, "method": "rendered-ocr", "engine": "ml-kit", "revision": "1", "durationMs": 2.0, "status": "complete", "text": "own\nseen", "embeddedText": "own", "blocks": [_BLOCK], "characterCount": 8, "warnings": ["PDF_EMBEDDED_TEXT_SPARSE"]}, {"text": "seen"}),
    "pdf-info": (R.PDF_INFO, R.valid_pdf_info, {"schemaVersion": 1, "pageCount": 25, "byteCount": 5, "sha256": _SHA, "engine": "pdfkit", "revision": "1", "limit": {"pages": 25, "bytes": 52_428_800}}, {"pageCount": 26}),
    "text-file": (R.TEXT_FILE, R.valid_text_file, {"schemaVersion": 1, "text": "é", "byteCount": 2, "encoding": "utf-8", "revision": "1"}, {"byteCount": 1}),
    "normalized": (R.NORMALIZED, R.valid_normalized, {"schemaVersion": 1, "normalizationVersion": "text-normalization-v1", "contentKind": "prose", "text": "\U0001f600", "characterCount": 2, "utf8ByteCount": 4, "warnings": ["UNICODE_NORMALIZED"]}, {"characterCount": 1}),
    "image-hash": (R.IMAGE_HASH, R.valid_image_hash, _HASH, {"hash": "0" * 15}),
    "analysis": (R.ANALYSIS, R.valid_analysis, {"schemaVersion": 1, "packId": _ID, "itemId": _ID, "originalSha256": _SHA, "originalByteCount": 9, "normalizedArtifactId": _ID, "normalizedSha256": _SHA, "normalizedByteCount": 8, "normalizedCharacterCount": 7, "contentKind": "code", "textFingerprint": _PRINT, "imageFingerprint": _HASH, "analyzedAt": _AT}, {"normalizedByteCount": 6}),
    "suggestion": (R.SUGGESTION, R.valid_suggestion, {"schemaVersion": 1, "key": f"near-image:{_ID}:{_ID[:-1]}6", "packId": _ID, "leftItemId": _ID, "rightItemId": _ID[:-1] + "6", "reason": "near-image", "confidence": 0.9, "expectedBytesSaved": 1, "expectedCharactersSaved": 0}, {"reason": "similar-text"}),
    "analysis-manifest": (R.ANALYSIS_MANIFEST, R.valid_analysis_manifest, {"schemaVersion": 1, "packId": _ID, "config": R.DETECTOR, "analyzedAt": _AT, "itemCount": 2, "suggestionCount": 1}, {"analyzedAt": "2023-02-29T12:00:00Z"}),
    "decision": (R.DECISION, R.valid_decision, {"schemaVersion": 1, "packId": _ID, "itemId": _ID, "choice": "preferred", "baselineInclusionMode": "both", "source": "standalone", "decidedAt": _AT}, {"choice": "drop"}),
    "checkpoint": (C.CHECKPOINT, C.valid_checkpoint, {"schemaVersion": 1, "id": _ID, "runId": _ID, "packId": _ID, "stage": "extract", "reason": "stage-failure", "resumeAction": "retry-stage", "completedArtifactIds": [], "processor": "p", "processorVersion": "1", "updatedAt": _AT, "errorCode": "PDF_CORRUPT"}, {"resumeAction": "continue"}),
    "finding": (C.FINDING, C.valid_finding, {"schemaVersion": 1, "id": _ID, "itemId": _ID, "detector": "d", "detectorVersion": "1", "category": "jwt", "severity": "high", "confidence": 1.0, "location": {"kind": "text-range", "start": 0, "length": 4}, "decision": "pending"}, {"confidence": 1.5}),
    "export": (C.EXPORT, C.valid_export, {"schemaVersion": 1, "exportId": _ID, "packId": _ID, "createdAt": _AT, "format": "markdown", "artifacts": [{"id": _ID, "kind": "markdown", "relativePath": "a/b.md", "mediaType": "text/markdown", "byteCount": 1, "sha256": _SHA}], "privacyReview": {"status": "complete", "decisionSetSha256": _SHA}}, {"artifacts": []}),
    "ocr": (C.OCR, C.valid_ocr, {"schemaVersion": 1, "text": "seen", "blocks": [_BLOCK], "durationMs": 1.0, "engine": "ml-kit-latin", "revision": "1"}, {"engine": "other"}),
}


@query(
    f"""SELECT doc_id, kind, CASE doc_id % 4 WHEN 1 THEN 'SCHEMA_VERSION_UNSUPPORTED' WHEN 2 THEN 'SCHEMA_INVALID' WHEN 3 THEN 'SCHEMA_INVALID' END AS error_code FROM documents, (SELECT unnest([{", ".join(repr(k) for k in RECORDS)}]) AS kind)""",
    "documents",
)
def records_valid(docs: DataFrame) -> DataFrame:
    """A record of each kind for each document: valid, of another version, with a wrong value, or with a key too many."""
    out = None
    for kind, (schema, valid, good, change) in RECORDS.items():
        payloads = [good, good | {"schemaVersion": 2}, good | change, good | {"more": 1}]
        json_of = F.element_at(F.array(*[F.lit(json.dumps(p)) for p in payloads]), (F.col("doc_id") % 4 + 1).cast("int"))
        rows = docs.select("doc_id", F.lit(kind).alias("kind"), json_of.alias("payload")).select("doc_id", "kind", C.decode(F.col("payload"), schema, valid, has_udf=kind == "page")["error_code"].alias("error_code"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE '{"event":"import_completed","count":' || event_id || ',"durationMs":' || CASE WHEN event_id % 2 = 0 THEN '1.5' ELSE '2' END || ',"version":"1.2"}' END AS line FROM events""",
    "events",
)
def safe_log(events: DataFrame) -> DataFrame:
    """What may be logged of events; an unknown key and a text in place of a version keep a record out."""
    record = F.struct(F.lit("1.2").alias("version"), F.when(F.col("event_id") % 2 == 0, 1.5).otherwise(2.0).alias("durationMs"), F.lit("import_completed").alias("event"), F.col("event_id").alias("count"), F.when(F.col("event_type") == "error", "x").alias("text"))
    made = F.when(F.col("event_type") == "click", F.replace(F.to_json(record), F.lit('"1.2"'), F.lit('"secret"'))).otherwise(F.to_json(record))
    return events.select("event_id", R.log_line(made).alias("line"))


@query("SELECT r.error_code, count(*) AS runs, CASE WHEN error_code = 'OCR_FAILED' THEN NULL WHEN error_code = 'TEXT_TOO_LARGE' THEN 'user-action-required' ELSE 'retryable' END AS disposition FROM runs r WHERE r.error_code IS NOT NULL GROUP BY r.error_code", "runs")
def run_errors(runs: DataFrame) -> DataFrame:
    """Failed runs by code, with what the catalog of errors says of it; null for a code that it has not."""
    known = F.broadcast(error_catalog(runs.sparkSession).select("error_code", "disposition"))  # 38 rows
    found = runs.filter("error_code is not null").groupBy("error_code").agg(F.count("*").alias("runs"))
    return found.join(known, "error_code", "left").select("error_code", "runs", "disposition")


_LUHN = "list_sum(list_transform(list_filter(string_split(reverse(v), ''), lambda c: c BETWEEN '0' AND '9'), lambda d, i: CASE WHEN i % 2 = 0 THEN CAST(d AS INT) * 2 % 10 + CAST(d AS INT) * 2 // 10 ELSE CAST(d AS INT) END)) % 10 = 0"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS v FROM documents" for c, p in privacy.PATTERNS.items())


@query(f"SELECT doc_id, category, count(*) AS findings, CAST(sum(length(v)) AS BIGINT) AS characters FROM ({_FOUND}) WHERE category <> 'payment-card' OR {_LUHN} GROUP BY doc_id, category", "documents")
def pii_findings(docs: DataFrame) -> DataFrame:
    return privacy.findings(docs.select("doc_id", "text")).groupBy("doc_id", "category").agg(F.count("*").alias("findings"), F.sum("length").cast("long").alias("characters"))


_CUT = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{c}' AS category, regexp_extract_all(text, '{_p}') AS vs, regexp_split_to_array(text, '{_p}') AS gaps FROM documents" for i, (c, _p) in enumerate((c, p.replace("'", "''")) for c, p in privacy.PATTERNS.items()))


@query(
    f"""WITH cut AS (SELECT * FROM ({_CUT}) WHERE len(vs) > 0),
    found AS (SELECT doc_id, rank, category, vs[k] AS v, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(vs[1:k - 1], lambda w: length(w))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS k FROM cut)),
    spans AS (SELECT doc_id, rank, category, start, start + length(v) AS stop FROM found WHERE category <> 'payment-card' OR {_LUHN}),
    marked AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= start AS fresh FROM spans),
    grouped AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS UNBOUNDED PRECEDING) AS g FROM marked),
    stretches AS (SELECT doc_id, g, min(start) AS start, max(stop) AS stop, first(category ORDER BY start, stop DESC, rank) AS category FROM grouped GROUP BY doc_id, g),
    chained AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY g), 0) AS before FROM stretches),
    made AS (SELECT c.doc_id, string_agg(substr(d.text, before + 1, start - before) || '[REDACTED_' || upper(replace(category, '-', '_')) || ']', '' ORDER BY g) || substr(any_value(d.text), max(stop) + 1) AS text FROM chained c JOIN documents d USING (doc_id) GROUP BY c.doc_id)
    SELECT d.doc_id, md5(coalesce(m.text, d.text)) AS text_md5 FROM documents d LEFT JOIN made m USING (doc_id)""",
    "documents",
)
def pii_redacted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.md5(privacy.redact(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS quality, CAST(ceil(strlen(text) / 4.0 * 0.6::DOUBLE) AS BIGINT) AS balanced FROM documents", "documents")
def token_estimate(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", privacy.token_estimate(F.col("text")).alias("quality"), privacy.token_estimate(F.col("text"), "balanced").alias("balanced"))


@query(
    """SELECT conv_id AS pack_id, md5('# ' || conv_id || E'\\n\\n' || string_agg('- [Turn ' || turn || '](#turn-' || turn || ')', E'\\n' ORDER BY turn) || E'\\n\\n' || string_agg('## Turn ' || turn || E'\\n\\n' || text, E'\\n\\n' ORDER BY turn) || E'\\n') AS markdown_md5 FROM conversations GROUP BY conv_id""",
    "conversations",
)
def markdown_pack(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").alias("pack_id"), F.col("turn").alias("sort_index"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), "text", F.lit("prose").alias("kind"))
    return privacy.markdown(rows).select("pack_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query(
    f"""SELECT page_id, regexp_matches(url, '^https?://[^/?#]*[^/?#@:]') AS web, CASE WHEN length(t) BETWEEN 1 AND 120 THEN t END AS title, page_id % 3 <> 0 AS canonical FROM (
          SELECT page_id, url, regexp_replace('\t ' || left(html, CAST(page_id % 130 AS INTEGER)) || ' ', '^[{_B}]+|[{_B}]+$', '', 'g') AS t FROM pages)""",
    "pages",
)
def page_labels(rows: DataFrame) -> DataFrame:
    """Whether addresses are web addresses, a bounded title of each page, and identifiers, some spoiled."""
    title = F.concat(F.lit("\t "), F.left("html", (F.col("page_id") % 130).cast("int")), F.lit(" "))
    made = F.when(F.col("page_id") % 3 == 0, F.upper(U.uuid_of(F.col("url"), F.lit("A")))).otherwise(U.uuid_of(F.col("url"), F.col("html")))
    return rows.select("page_id", U.is_web_url(F.col("url")).alias("web"), U.bounded_text(title, 120).alias("title"), C.is_uuid(F.when(F.col("page_id") % 3 == 0, F.concat(made, F.lit("A"))).otherwise(made)).alias("canonical"))


@query(
    """SELECT vec_id, round(CASE WHEN len(good) > 0 THEN greatest(0, least(1, list_sum(good) / len(good))) END, 9) AS confidence, len(list_filter(e, lambda x: x < 0.5)) > 0 AS low,
         round(greatest(0, least(100, e[1] * 400)) / 100, 9) AS x, round(1 - greatest(0, least(50, e[2] * 100 + 20)) / 50, 9) AS y, round(least(2200.0 / greatest(1000 + vec_id, 800), sqrt(CASE WHEN vec_id % 2 = 0 THEN 4000000.0 ELSE 8000000.0 END / ((1000 + vec_id) * 800.0))), 9) AS scale
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0) AS good FROM embeddings)""",
    "embeddings",
)
def ocr_numbers(vectors: DataFrame) -> DataFrame:
    """Vectors as confidences of lines and bounds of blocks: means, flags, bounds flipped and cut, and the scale to draw a page at."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    at = lambda i: F.get(e, F.lit(i))
    b = pages.normalized_bounds(at(0) * 400, at(1) * 100, F.lit(10.0), F.lit(20.0), F.lit(100), F.lit(50), flipped=True)
    scale = pages.render_scale((F.col("vec_id") + 1000).cast("double"), F.lit(800.0), F.col("vec_id") % 2 == 0)
    return vectors.select("vec_id", F.round(pages.block_confidence(e), 9).alias("confidence"), pages.low_confidence(e).alias("low"), F.round(b["x"], 9).alias("x"), F.round(b["y"], 9).alias("y"), F.round(scale, 9).alias("scale"))


@query(
    """SELECT vec_id, CASE WHEN vec_id % 7 * 10000000 > 52428800 THEN 'IMAGE_SIZE_LIMIT_EXCEEDED' WHEN w = 0 OR h = 0 THEN 'IMAGE_DECODE_FAILED' WHEN w * h > CASE WHEN vec_id % 2 = 0 THEN 16000000 ELSE 1000000 END THEN 'IMAGE_PIXEL_LIMIT_EXCEEDED' END AS error_code
       FROM (SELECT vec_id, vec_id % 61 * 100 AS w, vec_id % 53 * 100 AS h FROM embeddings)""",
    "embeddings",
)
def image_limits(vectors: DataFrame) -> DataFrame:
    """Images of all sizes, every other one of which can't be read by regions."""
    k = F.col("vec_id")
    return vectors.select("vec_id", images.image_limits(k % 7 * 10_000_000, k % 61 * 100, k % 53 * 100, k % 2 == 0).alias("error_code"))


@query("SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS whole, doc_id % 3 = 0 AS encrypted, CASE WHEN doc_id % 3 = 0 THEN 'chinese' WHEN doc_id % 2 = 0 THEN 'latin' END AS script FROM documents", "documents")
def pdf_checks(docs: DataFrame) -> DataFrame:
    """Texts between a head and a trailer as of a PDF, some without one of its ends, and the script that engines are ready for."""
    k = F.col("doc_id")
    head, tail = F.when(k % 5 == 0, "").otherwise("%PDF-1.4\n"), F.when(k % 7 == 0, "").otherwise("\n%%EOF\n")
    trailer = F.concat(F.lit("\ntrailer\n<< /Size 3"), F.when(k % 3 == 0, " /Encrypt 5 0 R").otherwise(""), F.lit(" >>\nstartxref\n9"))
    content = F.concat(head, F.coalesce("text", F.lit("")), trailer, tail).cast("binary")
    latin = F.struct((k % 2 == 0).alias("ready"), F.array(F.lit("latin")).alias("scripts"))
    both = F.struct((k % 3 == 0).alias("ready"), F.array(F.lit("latin"), F.lit("chinese")).alias("scripts"))
    script = R.script_of(F.struct(F.array(latin, both).alias("engines")))
    return docs.select("doc_id", pages.pdf_envelope(content).alias("whole"), pages.pdf_encrypted(content).alias("encrypted"), script.alias("script"))


@query(
    """SELECT conv_id AS task_id, CAST(turn AS BIGINT) AS page_index, CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'complete' END AS status, row_number() OVER w AS done, round(row_number() OVER w / CAST(n AS DOUBLE), 6) AS share
       FROM (SELECT DISTINCT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) + 3 AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)""",
    "conversations",
)
def page_progress(turns: DataFrame) -> DataFrame:
    """Turns as pages that end from the last one on; every third ends again, failed."""
    counts = turns.groupBy(F.col("conv_id").alias("task_id")).agg((F.max("turn") + 3).cast("long").alias("page_count"))
    index = F.col("turn").cast("long").alias("page_index")
    ends = turns.select(F.col("conv_id").alias("t"), index, F.lit("complete").alias("status"), (-F.col("turn")).cast("long").alias("seq"))
    again = turns.filter("turn % 3 = 0").select(F.col("conv_id").alias("t"), index, F.lit("failed").alias("status"), (F.col("turn") + 1_000_000).cast("long").alias("seq"))
    rows = ends.unionByName(again).join(counts, F.col("t") == F.col("task_id")).drop("t")
    return pages.task_progress(rows).select("task_id", "page_index", "status", "done", "share")
