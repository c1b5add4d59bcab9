"""WARC archives, and their fixity: Merkle trees over records and ordered offset ranges, compared between replicas."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import remove, shared_dir, written

#: Bytes of an offset range, the lowest node above records, and the nodes that one above has as children.
RANGE, FAN = 1 << 20, 16

#: Packed bytes that are unpacked at once, and those from which a member is known to start a record.
SLICE, HEAD = 1 << 14, 1 << 10

#: Records and bytes of payload that a batch of rows has at most, but for one record.
BATCH_ROWS, BATCH_BYTES = 1_024, 16 << 20

_RECORD = "file string, offset long, length long, record_id string, warc_type string, url string, date string, content_type string, sha256 string, payload binary, complete boolean"


# Reading and writing records.


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The text of a WARC 1.0 resource record of a page, without the two line ends that follow it; nulls are empty.

    Its id is of the page's id and of what the page says, so it stays readable where the body is damaged. Line ends of
    url can't forge headers.
    """
    page, url, body = F.coalesce(page_id.cast("string"), F.lit("")), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " "), F.coalesce(body, F.lit(""))
    lines = [
        "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", page, ":", F.sha2(F.concat(url, F.lit("\n"), body).cast("binary"), 256), ">\r\nWARC-Target-URI: ", url,
        "\r\nWARC-Payload-Digest: sha256:", F.sha2(body.cast("binary"), 256), "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n", body,
    ]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def parse(stream: io.BufferedIOBase, at: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes, bool, str]]:
    """(offset, length, headers with lower-case names, payload, complete, SHA-256 of head and payload) of each record; what is not a record is passed over line by line."""
    while line := stream.readline():
        start, size = at, len(line)
        at += size
        if not line.startswith(b"WARC/"):
            continue
        headers, ended, digest = {}, False, sha256(line)
        while raw := stream.readline():
            at += len(raw)
            digest.update(raw)
            if not raw.strip():
                ended = True
                break
            name, _, value = raw.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        wanted = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        payload = stream.read(wanted)
        at += len(payload)
        digest.update(payload)
        yield start, at - start, headers, payload, ended and len(payload) == wanted, digest.hexdigest()


def _unpacked(content: bytes, at: int, most: int | None = None) -> tuple[bytes, int, bool]:
    """What the gzip member at a byte gives up to its end or an error, or to about so many packed bytes; where it ends; whether it is whole."""
    unpack, out, end = zlib.decompressobj(31), [], at
    last = len(content) if most is None else min(len(content), at + most)
    while end < last and not unpack.eof:
        piece, before = content[end : min(end + SLICE, last)], unpack.copy()
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            # Byte by byte, for what comes out before the one that is wrong.
            with suppress(zlib.error):
                for k in range(len(piece)):
                    out.append(before.decompress(piece[k : k + 1]))
            return b"".join(out), end, False
        end += len(piece)
    return b"".join(out), end - len(unpack.unused_data), unpack.eof


def _next_member(content: bytes, at: int) -> int | None:
    """Where the first gzip member of a record from a byte on starts; gzip data inside of payloads are passed over."""
    while (at := content.find(b"\x1f\x8b\x08", at)) >= 0:
        if _unpacked(content, at, HEAD)[0].startswith(b"WARC/"):
            return at
        at += 1
    return None


def parse_file(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bool, str]]:
    """As parse, for a whole file, plain or of gzip members; offsets and lengths of members are those in the file.

    The records of a damaged or truncated member come with complete false, or one without headers if none can be
    unpacked; such a member lasts to the next one that starts a record. Zeros after a member are padding.
    """
    if content[:2] != b"\x1f\x8b":
        first = None if content.startswith(b"WARC/") else _next_member(content, 0)
        # The first member may be the one that is damaged, in its first two bytes.
        if first is None or content.find(b"\nWARC/", 0, first) >= 0:
            yield from parse(io.BytesIO(content))
            return
    at = 0
    while at < len(content):
        data, end, whole = _unpacked(content, at)
        if not whole:
            after = _next_member(content, at + 1)
            end = len(content) if after is None else after
            if not content[at] and not content[at:end].strip(b"\0"):
                at = end
                continue
        found = False
        for _, _, headers, payload, complete, digest in parse(io.BytesIO(data)):
            found = True
            yield at, end - at, headers, payload, complete and whole, digest
        if not found and not whole:
            yield at, end - at, {}, data, False, sha256(data).hexdigest()
        at = end


def _parsed(with_payload: bool):
    """Files to rows of records, in batches of bounded size."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary(), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, size = batch.column(0)[i].as_py(), [], 0
                for o, n, h, payload, ok, digest in parse_file(batch.column(1)[i].as_py() or b""):
                    rows.append((path, o, n, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), digest, payload if with_payload else None, ok))
                    size += len(payload)
                    if len(rows) >= BATCH_ROWS or with_payload and size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of WARC files (plain or gzip members, under 2 GB each) at a path or glob, a row a record.

    Truncated and damaged records come with what there is of them and complete = false, and intact ones after them as
    they are; a file without records gives no rows. Without payload, that column is null and only hashes leave the task
    that reads a file. Returns file, offset, length, record_id, warc_type, url, date, content_type, sha256 (of head and
    payload), payload, complete; headers that a record lacks are null.
    """
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed(payload), _RECORD)


def write_warc(records: DataFrame, folder: str, compress: bool = False) -> None:
    """Write the text of records (column record, as record() makes it) as WARC files into a new folder.

    The engine's own writer does it, so any store that the cluster reaches will do, each task writes the rows that it
    has, and the files of a task that is lost are written again. A record ends with two line ends, as the format has it:
    the text's own and the writer's. A file has 4,000 records at most; with compress, each file is one gzip member.
    """
    out = records.select(F.concat(F.col("record"), F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", 4_000)
    out.text(folder, compression="gzip" if compress else "none")


# Fixity.


def _node(rows: DataFrame, at: Column) -> DataFrame:
    """A level of a tree: node, and the hash over its children in the order of their offsets."""
    grouped = rows.groupBy(at.cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("children"))
    return grouped.select("node", F.sha2(F.array_join(F.transform("children", lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["hash"])), "\n"), 256).alias("hash"))


class FixityTree:
    """levels[0] are records (node is the offset, hash the record's), levels[1] offset ranges, the last the root alone."""

    def __init__(self, records: DataFrame, total: int):
        """records: offset, sha256. total: the bytes of the archive, for both replicas alike."""
        rows = records.select(F.col("offset").alias("node"), F.col("sha256").alias("hash"))
        self.levels, self.spans = [rows], [RANGE]
        at, count = F.floor(F.col("node") / RANGE), max(1, -(-total // RANGE))
        while True:
            rows = written(_node(rows.select("node", F.col("node").alias("at"), "hash"), at), "warc-nodes")
            self.levels.append(rows)
            self.spans.append(FAN)
            if count == 1:
                break
            at, count = F.floor(F.col("node") / FAN), -(-count // FAN)

    @property
    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row["hash"] if row else None


def mismatches(left: FixityTree, right: FixityTree) -> DataFrame:
    """node (offset), status of the records in which two replicas differ: corrupt, missing or extra in the right one.

    Roots are compared first; below, only the children of nodes that differ are read and compared.
    """
    bad = None
    for depth in range(len(left.levels) - 1, -1, -1):
        a, b = (t.levels[depth] for t in (left, right))
        if bad is not None:
            above = bad.select(F.col("node").alias("parent"))
            at = F.floor(F.col("node") / left.spans[depth]).cast("long")
            a, b = (x.join(above, at == F.col("parent"), "left_semi") for x in (a, b))
        a, b = a.toDF("l_node", "l_hash"), b.toDF("r_node", "r_hash")
        both = a.join(b, F.col("l_node") == F.col("r_node"), "full_outer").filter(~F.col("l_hash").eqNullSafe(F.col("r_hash")))
        status = F.when(F.col("r_hash").isNull(), "missing").when(F.col("l_hash").isNull(), "extra").otherwise("corrupt")
        bad = written(both.select(F.coalesce("l_node", "r_node").alias("node"), status.alias("status")), "warc-bad")
        if bad.isEmpty():
            break
    return bad if not depth else bad.filter("false")


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """records (offset, length, sha256, ...) with the status of each in a replica (offset, sha256): ok, corrupt or missing.

    Offsets are unique in either table. Null hashes count as corrupt against others. An empty archive gives no rows.
    """
    total = records.agg(F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0))).first()[0]
    left, right = FixityTree(records, total), FixityTree(replica, total)
    if left.root == right.root:
        return records.withColumn("status", F.lit("ok"))
    bad = mismatches(left, right).withColumnRenamed("status", "found")
    return records.join(bad, F.col("offset") == F.col("node"), "left").drop("node").withColumn("status", F.coalesce("found", F.lit("ok"))).drop("found")


def manifest(records: DataFrame) -> DataFrame:
    """record_id, offset, length, sha256 of an archive's records (as read_warc gives them), each id once.

    Offsets are over all files in the order of their names: a small table of their sizes is summed, a row a file.
    Records that repeat an id count as one at the first place: sha256 then is of the least and greatest of their hashes
    and of their number. Rows without a record id have no place here.
    """
    sizes = records.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    sizes = sizes.select(F.col("file").alias("s_file"), before.alias("before"))
    placed = records.filter("record_id is not null").join(sizes, F.col("file") == F.col("s_file")).withColumn("at", F.col("before") + F.col("offset"))
    least, most, n = F.min("sha256"), F.max("sha256"), F.count("*")
    digest = F.when(n == 1, least).otherwise(F.sha2(F.concat_ws(":", least, most, n.cast("string")), 256))
    return placed.groupBy("record_id").agg(F.min("at").cast("long").alias("offset"), F.min_by("length", "at").alias("length"), F.min_by("sha256", "at").alias("record_sha256"), digest.alias("sha256"), n.alias("copies"))


def audit_archives(original: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of an archive with their status in a replica of it, whose files may be cut otherwise.

    original, replica: as read_warc gives them. A replica's records stand at the offsets that the original's manifest
    has for their ids, so one that is lost moves no other; the trees over both are then compared from their roots down.
    Returns record_id, offset, length, record_sha256, copies, status (ok, corrupt, missing; extra for ids that only the
    replica has, with its own values and no offset). Empty archives give no rows.
    """
    own = written(manifest(original), "warc-manifest")
    there = written(manifest(replica).select(F.col("record_id").alias("r_id"), F.col("length").alias("r_length"), F.col("record_sha256").alias("r_record"), F.col("sha256").alias("r_sha256"), F.col("copies").alias("r_copies")), "warc-replica")
    placed = there.join(own.select("record_id", "offset"), F.col("r_id") == F.col("record_id"), "left")
    found = audit(own, placed.filter("offset is not null").select("offset", F.col("r_sha256").alias("sha256"))).drop("sha256")
    extra = placed.filter("offset is null").select(F.col("r_id").alias("record_id"), "offset", F.col("r_length").alias("length"), F.col("r_record").alias("record_sha256"), F.col("r_copies").alias("copies"), F.lit("extra").alias("status"))
    return found.unionByName(extra)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as WARC files, twice: in the replica, records whose md5(page_id) starts with 07 have the last
    character of their body changed (of their head, where the body is empty) and those with 0a are lost. Both archives
    are read back and audited. Pages that repeat wholly are one record; null ids, urls and bodies are empty in a record
    and null ids come out null. An empty table gives no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = record(F.col("page_id"), F.col("url"), F.col("html"))
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    damaged = F.concat(raw.substr(F.lit(1), F.length(raw) - 1), F.when(F.endswith(raw, F.lit("?")), "!").otherwise("?"))
    hashes = []
    for name, records in (("original", pages.select(raw.alias("record"))), ("replica", pages.filter(mark != "0a").select(F.when(mark == "07", damaged).otherwise(raw).alias("record")))):
        folder = f"{shared_dir(spark)}/warc-{name}-{uuid.uuid4().hex}"
        write_warc(records, folder)
        hashes.append(written(read_warc(spark, folder, payload=False).select("file", "offset", "length", "record_id", "sha256"), f"warc-{name}-hashes"))
        remove(spark, folder)
    found = audit_archives(*hashes)
    page = F.regexp_extract("record_id", "^<urn:page:([^:]*):", 1)
    return found.select(F.when(page != "", page).cast("long").alias("page_id"), "length", "record_sha256", "copies", "status")


OP5_SQL = r"""
WITH raw AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') AS url, coalesce(html, '') AS html FROM pages),
records AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || sha256(url || chr(10) || html) || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10)
         || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10)
         || chr(13) || chr(10) || html AS record
  FROM raw)
SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS record_sha256, count(*) AS copies,
       CASE substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) WHEN '07' THEN 'corrupt' WHEN '0a' THEN 'missing' ELSE 'ok' END AS status
FROM records GROUP BY page_id, record
"""
