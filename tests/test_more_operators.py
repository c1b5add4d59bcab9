from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import urls as U
from quirework.functions import weburl
from quirework.operators import files, images, pages, privacy, records, tables
from quirework.operators.fold import folded
from quirework.streaming import events as E

ID = "11111111-2222-4333-8444-555555555555"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ADDRESSES = [
    ("http://EXAMPLE.com/a/../b", "http://example.com/b"),
    ("https://münchen.de/ä?ö#ü", "https://xn--mnchen-3ya.de/%C3%A4?%C3%B6#%C3%BC"),
    ("http://a/b c", "http://a/b%20c"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://[2001:db8::0:1]:80/x", "http://[2001:db8::1]/x"),
    ("http:\\\\a\\b\\..\\c", "http://a/c"),
    ("https://a:443", "https://a/"),
    ("https://a:8443/", "https://a:8443/"),
    ("http://a/%2e%2e/x/./", "http://a/x/"),
    ("http://a/..", "http://a/"),
    ("https://a?x='y'", "https://a/?x=%27y%27"),
    ("http://u:p%40@h/", "http://u:p%40@h/"),
    ("http://1.2.3.999/", None),
    ("http://a b/", None),
    ("http://a:99999/", None),
    ("http://a<b/", None),
    ("ftp://a/", None),
]


@pytest.mark.parametrize("given, wanted", ADDRESSES)
def test_normal_form(given, wanted):
    assert weburl.normalize(given) == wanted
    if wanted:
        assert weburl.normalize(wanted) == wanted


def test_plain_addresses_need_no_parsing(spark):
    rows = [(g, w) for g, w in ADDRESSES if w] + [(w, w) for _, w in ADDRESSES if w] + [("https://a.b/c?d=e&f#g", "https://a.b/c?d=e&f#g")]
    got = spark.createDataFrame(rows, "given string, wanted string").select("given", "wanted", weburl.needs_parsing(F.col("given")).alias("odd"), U.extract_url(F.col("given")).alias("u")).collect()
    for r in got:
        # What passes without parsing is a normal form but for its default port and empty path.
        assert r["odd"] or weburl.normalize(r["given"]) in (r["given"], r["given"].replace(":443", "") + "/", r["wanted"])
        host = r["wanted"].split("://")[1].split("/")[0].rpartition("@")[2]
        assert (r["u"]["host"], r["u"]["error_code"]) == (host, None)
    bad = spark.createDataFrame([(g,) for g, w in ADDRESSES if not w] + [(" http://a/",), (None,)], "u string").select(U.extract_url(F.col("u")).alias("u")).collect()
    assert {r["u"]["error_code"] for r in bad} == {"URL_INVALID"} and all(r["u"]["host"] is None for r in bad)


def test_redaction_of_overlaps(spark):
    text = "see https://joe:pw1@mail.example.org/x, 2001:db8::10 or 192.0.2.10; joe@example.org é card 4242 4242 4242 4242, not 4242 4242 4242 4241; [REDACTED_API_KEY] 12:34:56"
    plain = one(spark, privacy.redact(F.lit(text)))
    assert plain == "see [REDACTED_URL_CREDENTIAL]/x, [REDACTED_IP_ADDRESS] or [REDACTED_IP_ADDRESS]; [REDACTED_EMAIL] é card [REDACTED_PAYMENT_CARD], not 4242 4242 4242 4241; [REDACTED_API_KEY] 12:34:56"
    assert one(spark, privacy.redact(F.lit(plain))) == plain
    kept = one(spark, privacy.redact(F.lit(text), F.array(F.lit("email"), F.lit(f"ip-address:{text.index('2001')}"))))
    assert "joe@example.org" in kept and "2001:db8::10" in kept and "192.0.2.10" not in kept
    # pw1@mail.example.org is an address too, and overlaps the credential: one stretch.
    found = one(spark, privacy.all_spans(F.lit(text)))
    assert all(a["start"] + a["length"] <= b["start"] for a, b in zip(found, found[1:]))
    assert one(spark, privacy.redact(F.lit(""))) == "" and one(spark, privacy.redact(F.lit(None).cast("string"))) is None


def test_fold_over_small_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.randrange(9)) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table = spark.createDataFrame(rows, "key string, seq long, n long")
        step = lambda s, r: (s + r.n, None)
        got = {r["key"]: (r["total"], r["rows"]) for r in folded(table, "key", ["seq"], lambda: 0, step, lambda k, s, n: (k, s, n), "key string, total long, rows long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (sum(n for x, _, n in rows if x == k), sum(x == k for x, _, _ in rows)) for k in "abc"}
    assert folded(table.limit(0), "key", ["seq"], lambda: 0, step, lambda k, s, n: (k, s, n), "key string, total long, rows long").collect() == []


def test_routing_is_idempotent(spark, tmp_path):
    event = lambda i, **more: json.dumps({"schemaVersion": 1, "id": ID[:-1] + str(i), "result": "complete"} | more)
    first = [event(1), event(1), event(2, result="failed", code="SHARE_IMPORT_FAILED"), "{}"]
    second = [event(2, result="failed", code="SHARE_IMPORT_FAILED"), event(3, durable=True)]
    target = f"file://{tmp_path}/routed"
    route = E.route_events(target)
    for batch_id, rows in ((0, first), (1, second), (1, second)):
        route(spark.createDataFrame([(r,) for r in rows], "value string"), batch_id)
    ids = lambda table: sorted(r["id"][-1] for r in spark.read.parquet(f"{target}/{table}").collect())
    assert ids("acks") == ["1", "2", "3"] and ids("scans") == ["1", "3"] and ids("blockers") == ["2"]
    assert spark.read.parquet(f"{target}/rejected").count() == 1


def test_streams_of_nothing(spark):
    from quirework.plans import scalars

    assert scalars.event_routing(spark.createDataFrame([], "event_id long, user_id long, event_type string")).collect() == []
    items = "import_id long, item_id string, sort_index long, media_type string, status string, byte_count long"
    assert scalars.import_commits(spark.createDataFrame([], items)).collect() == []


def test_conflicts_are_kept_once(spark, tmp_path):
    target = f"file://{tmp_path}/table"
    schema = "value struct<ingestionId:string,createdAt:string,items:array<string>>, fingerprint string, error_code string"
    rows = [((ID, "2024", ["a"]), "f1", None), ((ID, "2025", ["b"]), "f2", None), (("other", "2024", []), "f3", "SCHEMA_INVALID")]
    commit = E.commit_imports(target)
    for batch_id in (0, 0, 1):
        commit(spark.createDataFrame(rows, schema), batch_id)
    assert [(r["ingestion_id"], r["fingerprint"], r["items"]) for r in spark.read.parquet(target).collect()] == [(ID, "f1", 1)]
    assert [(r["ingestion_id"], r["fingerprint"]) for r in spark.read.parquet(f"{target}-conflicts").collect()] == [(ID, "f2")]


def test_journal_stream_equals_batch(spark, tmp_path):
    rows = [("i", "p", "discovered", "2024-01-01", None), ("i", "p", "files-published", "2024-01-02", "X"), ("i", "p", "discovered", "2024-01-03", None), ("j", "q", "unknown", "2024-01-01", None), ("k", "q", "quarantined", "2024-01-01", None), ("k", "q", "database-committed", "2024-02-01", None)]
    batch = spark.createDataFrame(rows, "ingestion_id string, pack_id string, phase string, updated_at string, error_code string")
    want = {("i", "files-published"), ("k", "quarantined")}
    assert {(r["ingestion_id"], r["phase"]) for r in E.recovery_journal(batch).collect()} == want
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.recovery_journal(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("journal").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert {(r["ingestion_id"], r["phase"]) for r in spark.table("journal").collect()} == want


def test_cleanup_lease_has_one_holder(spark):
    rows = [(1, 0, "a", "claim", 100), (2, 50, "b", "claim", 100), (3, 90, "a", "renew", 100), (4, 189, "b", "claim", 100), (5, 190, "b", "claim", 100)]
    got = {r["seq"]: r["granted"] for r in E.cleanup_lease(spark.createDataFrame(rows, "seq long, at_ms long, session string, action string, ttl_ms long")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_placed_orders_all_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(3000)]
    got = tables.placed(spark.createDataFrame(rows, "a long, b long").repartition(7), F.desc_nulls_last("a"), "b").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, 3001))
    assert tables.placed(spark.createDataFrame([], "a long"), "a").collect() == []


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", "x", 2), (2, "b", "y", 1)], "id long, v string, made string, n long")
    changes = spark.createDataFrame([(1, "c", "never", 5), (1, "d", "never", 6), (3, "e", "first", 8), (3, "f", "later", 9), (None, "g", "z", 1)], "id long, v string, made string, at long")
    got = sorted(map(tuple, tables.upsert(table, changes, "id", ("v",), "at", counter="n").collect()))
    assert got == [(1, "d", "x", 4), (2, "b", "y", 1), (3, "f", "first", 2)]
    assert tables.upsert(table.drop("n"), changes.limit(0), "id", ("v",), "at").count() == 2


def test_compare_and_set(spark):
    table = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 1)], "id long, v string, revision long")
    changes = spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (2, 5, "z"), (4, None, "n"), (5, 1, "m")], "id long, expected long, v string")
    got = {r["id"]: (r["v"], r["revision"], r["outcome"]) for r in tables.compare_and_set(table, changes, "id", "revision", ("v",)).collect()}
    assert got == {1: ("x", 4, "updated"), 2: ("b", 1, "conflict"), 3: ("c", 1, "kept"), 4: ("n", 1, "inserted"), 5: (None, None, "conflict")}


def test_latest_instants(spark):
    assert one(spark, tables.latest_instant(F.lit("2024-01-01T00:00:00.5Z"), F.lit("2024-01-01T00:00:00.500Z"), F.lit(None))) == "2024-01-01T00:00:00.5Z"
    assert one(spark, tables.latest_instant(F.lit(None).cast("string"), F.lit("2024-01-01T00:00:00Z"))) == "2024-01-01T00:00:00Z"


def test_file_store(spark, tmp_path):
    for path, content in (("Packs/a.txt", b"one"), ("Packs/sub/b.txt", b"\xff\xfe"), ("Quarantine/c.bin", b"xyz")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    folder = f"file://{tmp_path}"
    assert {(r["path"], r["byte_count"]) for r in files.listing(spark, folder).collect()} == {("Packs/a.txt", 3), ("Packs/sub/b.txt", 2), ("Quarantine/c.bin", 3)}
    assert "content" not in files.listing(spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    known = spark.createDataFrame([(1, "Packs/a.txt", 3, sha(b"one")), (2, "Packs/sub/b.txt", 2, sha(b"zz")), (3, "Packs/no.txt", 1, sha(b"q"))], "id long, relative_path string, byte_count long, sha256 string")
    assert {r["id"]: r["status"] for r in files.verify(known, files.contents(spark, folder)).collect()} == {1: "verified", 2: "mismatch", 3: "missing"}
    texts = {r["path"]: (r["text"], r["error_code"]) for r in files.text_files(spark, folder, 3, known.select(F.col("relative_path").alias("path"), "byte_count", "sha256")).collect()}
    assert texts == {"Packs/a.txt": ("one", None), "Packs/sub/b.txt": (None, "ARTIFACT_INTEGRITY_FAILED"), "Quarantine/c.bin": (None, "ARTIFACT_INTEGRITY_FAILED")}
    assert {r["path"]: r["error_code"] for r in files.text_files(spark, folder).collect()} == {"Packs/a.txt": None, "Packs/sub/b.txt": "TEXT_INVALID_UTF8", "Quarantine/c.bin": None}
    assert tuple(files.usage(files.listing(spark, folder)).first()) == (2, 5, 1, 3)
    fresh = spark.createDataFrame([("Packs/a.txt", 3, sha(b"one")), ("Packs/no.txt", 9, sha(b"other")), ("Packs/n.txt", 1, "a"), ("Packs/n.txt", 1, "b"), ("../x", 1, "a")], "relative_path string, byte_count long, sha256 string")
    got = sorted((r["relative_path"], r["created"], r["error_code"]) for r in files.publish(known, fresh).collect())
    assert got == sorted([("Packs/a.txt", False, None), ("Packs/no.txt", False, "STORAGE_ARTIFACT_IMMUTABLE"), ("Packs/n.txt", True, None), ("Packs/n.txt", False, "STORAGE_ARTIFACT_IMMUTABLE"), ("../x", False, "SCHEMA_INVALID")], key=lambda r: (r[0], r[1], r[2] or ""))


def test_frames_and_limits(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x0dIHDR" + bytes(17)
    gif = b"GIF89a" + bytes(4) + b"\0\0\0"
    frame = b"\x2c" + bytes(9) + b"\x02\x01\x00\x00"
    cases = {
        png + b"\0\0\0\x08acTL\0\0\0\x02" + bytes(8): False, png + b"\0\0\0\x08acTL\0\0\0\x01" + bytes(8): True, png + b"\0\0\0\x01IDAT": True,
        gif + frame + b"\x3b": True, gif + frame + b"\x21\xf9\x04" + bytes(4) + b"\0" + frame + b"\x3b": False,
        b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x02" + bytes(9): False, b"RIFF\0\0\0\0WEBPVP8 \x02\0\0\0ab": True,
        b"\0\0\0\x14ftypavif\0\0\0\0avis": False, b"\0\0\0\x14ftypheic\0\0\0\0mif1": True, b"plain": True, b"": True,
    }
    got = spark.createDataFrame([(bytearray(k),) for k in cases] + [(None,)], "c binary").select("c", images.is_one_frame(F.col("c")).alias("x")).collect()
    assert {None if r["c"] is None else bytes(r["c"]): r["x"] for r in got} == {**cases, None: None}
    limit = lambda b, w, h, region=True: one(spark, images.image_limits(F.lit(b), F.lit(w), F.lit(h), F.lit(region)))
    assert [limit(1, 4000, 4000), limit(1, 4001, 4000), limit(52_428_801, 1, 1), limit(1, 1000, 1001, False), limit(1, 0, 5)] == [None, "IMAGE_PIXEL_LIMIT_EXCEEDED", "IMAGE_SIZE_LIMIT_EXCEEDED", "IMAGE_PIXEL_LIMIT_EXCEEDED", "IMAGE_DECODE_FAILED"]


def test_pdf_pages(spark):
    binary = lambda s: F.lit(s).cast("binary")
    assert one(spark, pages.pdf_encrypted(binary("%PDF-1.4\ntrailer << /Root 1 0 R /Encrypt 5 0 R >>\nstartxref\n9\n%%EOF")))
    assert not one(spark, pages.pdf_encrypted(binary("%PDF-1.4\n(/Encrypt in text)\ntrailer << /Root 1 0 R >>\nstartxref\n9\n%%EOF")))
    assert not one(spark, pages.pdf_encrypted(F.lit(None).cast("binary")))
    assert one(spark, pages.embedded_text(F.array(F.lit("a\r\nb"), F.lit("c\x00"), F.lit(None))))["text"] == "a\nb\nc�\n"
    assert one(spark, pages.embedded_text(F.array(F.repeat(F.lit("x"), 600_000), F.repeat(F.lit("y"), 400_000))))["error_code"] == "PDF_PAGE_EXTRACTION_FAILED"
    told = spark.createDataFrame([("t", 4, 1, "complete", 5), ("t", 4, 0, "failed", 3), ("t", 4, 1, "complete", 9)], "task_id string, page_count long, page_index long, status string, seq long")
    assert [(r["page_index"], r["done"], r["share"]) for r in sorted(pages.task_progress(told).collect(), key=lambda r: r["done"])] == [(0, 1, 0.25), (1, 2, 0.5)]


def test_records_one_by_one(spark):
    holds = lambda valid, schema, value: one(spark, valid(F.from_json(F.lit(json.dumps(value)), schema)))
    path = f"Packs/{ID}/originals/{ID}.png"
    sha = "ab" * 32
    handoff = {"id": ID, "itemId": ID, "relativePath": path, "mediaType": "image/png", "byteCount": 3, "sha256": sha}
    assert holds(records.valid_handoff, records.HANDOFF, handoff)
    for change in ({"itemId": ID[:-1] + "6"}, {"relativePath": path + ".partial"}, {"byteCount": -1}, {"mediaType": "png"}, {"sha256": "x"}):
        assert not holds(records.valid_handoff, records.HANDOFF, handoff | change)
    assert holds(records.valid_verification, records.VERIFICATION, {"relativePath": path, "status": "missing"})
    assert not holds(records.valid_verification, records.VERIFICATION, {"relativePath": path, "status": "verified"})
    assert holds(records.valid_quarantined, records.QUARANTINED, {"quarantined": False})
    assert not holds(records.valid_quarantined, records.QUARANTINED, {"quarantined": True})
    item = {"id": ID, "order": 0, "kind": "url", "declaredMediaType": "text/uri-list", "byteCount": 9, "text": "http://a/"}
    given = {"ingestionId": ID, "source": "main-app-text", "inputs": [item]}
    assert holds(records.valid_import_input, records.IMPORT_INPUT, given)
    for change in ({"source": "main-app-picker"}, {"inputs": []}, {"inputs": [item | {"byteCount": 8}]}, {"inputs": [item | {"text": " http://a", "byteCount": 9}]}, {"inputs": [item, item | {"order": 1}]}, {"inputs": [item | {"order": 1}]}):
        assert not holds(records.valid_import_input, records.IMPORT_INPUT, given | change)
    page = {"schemaVersion": 1, "pageIndex": 0, "method": "embedded-text", "engine": "pdfkit", "revision": "1", "durationMs": 1.0, "status": "complete", "text": "t", "blocks": []}
    assert holds(records.valid_page, records.PAGE, page)
    failed = {k: v for k, v in page.items() if k not in ("text", "blocks")} | {"status": "failed", "errorCode": "PDF_CORRUPT"}
    assert holds(records.valid_page, records.PAGE, failed)
    block = lambda y, x, t: {"text": t, "bounds": {"x": x, "y": y, "width": 0.1, "height": 0.01}}
    seen = page | {"method": "rendered-ocr", "engine": "ml-kit", "text": "a\nb", "blocks": [block(0.1, 0.1, "a"), block(0.105, 0.5, "b")]}
    assert holds(records.valid_page, records.PAGE, seen)
    for change in ({"blocks": seen["blocks"][::-1], "text": "b\na"}, {"text": "a b"}, {"engine": "pdfkit"}, {"characterCount": 2}, {"warnings": ["PDF_PAGE_EMPTY"] * 2}, {"embeddedText": "own", "text": "own\na\nb"}):
        assert not holds(records.valid_page, records.PAGE, seen | change)
    assert not holds(records.valid_page, records.PAGE, failed | {"errorCode": "OTHER"})
    scripts = lambda *engines: one(spark, records.script_of(F.from_json(F.lit(json.dumps({"engines": [{"scripts": s, "ready": r} for s, r in engines]})), records.CAPABILITIES)))
    assert [scripts((["latin"], True), (["chinese"], True)), scripts((["latin"], True), (["chinese"], False)), scripts((["latin"], False))] == ["chinese", "latin", None]


def test_log_lines(spark):
    line = lambda value: one(spark, records.log_line(F.lit(json.dumps(value))))
    assert line({"engine": "pdfkit", "event": "ocr_completed", "count": 3, "durationMs": 1.25, "anonymousId": ID}) == f'{{"event":"ocr_completed","count":3,"durationMs":1.25,"engine":"pdfkit","anonymousId":"{ID}"}}'
    for bad in ({"event": "other"}, {"event": "inbox_scan", "text": "x"}, {"event": "inbox_scan", "count": 1.5}, {"event": "inbox_scan", "bytes": -1}, {"event": "inbox_scan", "version": "1.a"}, {"event": "inbox_scan", "anonymousId": "joe"}, {"event": "inbox_scan", "code": "X"}):
        assert line(bad) is None
