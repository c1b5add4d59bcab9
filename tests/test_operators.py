from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.functions import sketch as S
from quirework.operators import contracts, dedup, images, pages, privacy, states
from quirework.operators.graph import components
from quirework.streaming import events as E


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    assert all((got[x] == got[y]) == (find(x) == find(y)) for x, y in itertools.combinations(sorted(linked), 2))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_text_is_of_normalised_texts(spark):
    code = "\n".join(f"    return value_{i:02d} + other(1);" for i in range(40))
    words = [f"word{i}gram" for i in range(60)]
    prose = " ".join(words)
    texts = [code, code.replace("\n", "\r\n"), prose, prose.replace("gram", "\u00adgr\u200bam"), "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in prose), " ".join(f"word{i}-\ngram" for i in range(60)), prose + " more"]
    items = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "pack_id string, item_id long, text string")
    rows = dedup.analyse(items)
    made = {r["item_id"]: r for r in rows.collect()}
    for i, t in enumerate(texts):
        want = code if i < 2 else prose if i < 6 else t
        r = made[i]
        assert (r["kind"], r["original_bytes"], r["bytes"], r["characters"]) == ("code" if i < 2 else "prose", len(t.encode()), len(want.encode()), len(want))
        assert r["sketch"] == S.sketch_of(want).tolist() and r["similarity_characters"] == len(want)
    edges = {(r["left_id"], r["right_id"]): r for r in dedup.similar_text(rows).unionByName(dedup.equal_sketches(rows)).collect()}
    assert set(edges) == {(0, 1), (2, 3), (2, 4), (2, 5), (2, 6)}
    assert all(e["confidence"] == 1 for (_, right), e in edges.items() if right < 6)
    assert all((e["bytes_saved"], e["characters_saved"]) == ((len(code),) * 2 if left == 0 else (len(prose),) * 2) for (left, _), e in edges.items())


def test_similar_text_is_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(9)) for _ in range(40)) for _ in range(12)]
    texts = []
    for t in base:
        texts += [t, t[: len(t) - 6], "changed " + t]
    texts += ["", "short", None, base[0]]
    items = spark.createDataFrame([("p", i, t or "") for i, t in enumerate(texts)], "pack_id string, item_id long, text string")
    rows = dedup.analyse(items)
    got = {(r["left_id"], r["right_id"]): r["confidence"] for r in dedup.similar_text(rows).collect()}
    first: dict = {}
    for i, t in enumerate(texts):
        if len(t or "") >= 20:
            first.setdefault(tuple(S.sketch_of(t.lower().strip()).tolist()), i)
    want = {}
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        share = len(set(a) & set(b)) / len(set(a) | set(b))
        if int(share * 1e6 + 0.5) / 1e6 >= 0.82:
            want[min(i, j), max(i, j)] = int(share * 1e6 + 0.5) / 1e6
    assert want and got == want


@pytest.mark.parametrize("hot", [2, 50])
def test_similar_text_with_hot_elements_and_sizes(spark, hot):
    rng = random.Random(6)
    letters = [chr(97 + i) for i in range(20)]
    base = "".join(rng.choices(letters, k=90))
    texts = [base[: 30 + 2 * i] for i in range(30)] + [base + "".join(rng.choices(letters, k=k)) for k in range(0, 40, 2)] + [base[:20] + "".join(rng.choices(letters, k=70)) for _ in range(20)]
    items = spark.createDataFrame([(None if i % 2 else "p", i, t) for i, t in enumerate(texts)], "pack_id string, item_id long, text string")
    got = {(r["left_id"], r["right_id"]): r["confidence"] for r in dedup.similar_text(dedup.analyse(items), hot).collect()}
    sketches = [set(S.sketch_of(t).tolist()) for t in texts]
    want = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        share = len(sketches[i] & sketches[j]) / len(sketches[i] | sketches[j])
        if i % 2 == j % 2 and int(share * 1e6 + 0.5) / 1e6 >= 0.82:
            want[i, j] = int(share * 1e6 + 0.5) / 1e6
    assert len(want) > 40 and got == want


def test_near_image(spark):
    rows = [("p", 1, "ffffffffffffffff", 5), ("p", 2, "ffffffffffffff00", 7), ("p", 3, "fffffffffffffe00", 9), ("q", 4, "ffffffffffffffff", 1), ("p", 5, None, 1), ("p", 6, "ffffffffffffffff", 1), (None, 7, "00", 1), (None, 8, "0000000000000000", 2), (None, 9, "0000000000000000", 3)]
    got = {(r["left_id"], r["right_id"], r["bytes_saved"], r["confidence"]) for r in dedup.near_image(spark.createDataFrame(rows, "pack_id string, item_id long, hash string, bytes long")).collect()}
    assert got == {(1, 2, 5, 0.875), (2, 3, 7, 0.984375), (1, 6, 1, 1.0), (8, 9, 2, 1.0)}


def test_reasons_have_an_order(spark):
    kinds = "pack_id string, left_id long, right_id long, confidence double, bytes_saved long, characters_saved long"
    exact = spark.createDataFrame([("p", 1, 1, 5), ("p", 2, 1, 5), ("p", 3, 3, 6)], "pack_id string, item_id long, representative long, bytes long")
    images = spark.createDataFrame([("p", 1, 2, 0.9, 1, 0), ("p", 1, 3, 0.9, 2, 0)], kinds)
    texts = spark.createDataFrame([("p", 1, 3, 0.85, 3, 3), ("p", 2, 3, 0.85, 4, 4)], kinds)
    got = {r["key"]: (r["confidence"], r["bytes_saved"]) for r in dedup.suggestions(exact, ("near-image", images), ("similar-text", texts)).collect()}
    assert got == {"exact-binary:1:2": (1.0, 5), "near-image:1:3": (0.9, 2), "similar-text:2:3": (0.85, 4)}


def test_group_savings_small_and_large(spark):
    edges = [("p", 1, 2, "similar-text", 0.9, 10, 3), ("p", 2, 3, "exact-binary", 1.0, 20, 0), ("p", 1, 3, "similar-text", 0.85, 15, 9), ("p", 7, 8, "exact-binary", 1.0, 4, 0)]
    df = spark.createDataFrame(edges, "pack_id string, left_id long, right_id long, reason string, confidence double, bytes_saved long, characters_saved long")
    want = {1: (3, ["exact-binary", "similar-text"], 1.0, 35, 12), 7: (2, ["exact-binary"], 1.0, 4, 0)}
    for bound in (100, 1):
        _, found = dedup.groups(df, bound)
        assert {r["group_id"]: (r["members"], r["reasons"], r["confidence"], r["bytes_saved"], r["characters_saved"]) for r in found.collect()} == want


def test_preferred_excludes_neighbours_alone(spark):
    edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3)], "pack_id string, left_id long, right_id long")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "item_id long, group_id long")
    got = {r["item_id"]: r["choice"] for r in dedup.prefer(edges, members, spark.createDataFrame([(1,)], "item_id long")).collect()}
    assert got == {1: "preferred", 2: "exclude", 3: "keep"}


def test_replay(spark):
    rows = [("a", 1, "start-processing"), ("a", 2, "mark-ready"), ("a", 3, "start-export"), ("a", 4, "mark-ready"), ("a", 5, "complete-export"), ("b", 1, "retry")]
    got = {r["key"]: (r["state"], r["rejected"]) for r in states.replay(spark.createDataFrame(rows, "key string, seq long, command string"), states.PACK_MOVES, "draft").collect()}
    assert got == {"a": ("exported", 1), "b": ("draft", 1)}
    assert len([1 for _, _, sources in states.PACK_MOVES for _ in sources]) == 27


def test_state_replay_is_brute_force(spark, sf):
    from quirework.plans.scalars import _COMMANDS, state_replay  # noqa: F401
    from quirework.registry import QUERIES

    table = {(c, s): to for c, to, sources in states.PACK_MOVES for s in sources}
    state: dict = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        own = state.setdefault(r["user_id"], ["draft", 0])
        to = table.get((_COMMANDS[r["event_id"] % len(_COMMANDS)], own[0]))
        own[:] = [to, own[1]] if to else [own[0], own[1] + 1]
    assert {r["key"]: [r["state"], r["rejected"]] for r in QUERIES["state_replay"](spark, sf).collect()} == state


def test_reading_order():
    b = lambda text, x, y: {"text": text, "x": x, "y": y, "width": 0.1, "height": 0.1}
    # The third is within the gap of the second but not of the row's first block.
    assert [x["text"] for x in pages._order([b("c", 0.0, 0.012), b("b", 0.5, 0.0), b("a", 0.9, 0.008)])] == ["b", "a", "c"]


def test_pages(spark):
    rows = [("d", 2, "complete", "two"), ("d", 1, "complete", "one"), ("e", 1, "failed", None), ("f", 1, "complete", None)]
    got = {r["key"]: (r["status"], r["text"]) for r in pages.document_text(spark.createDataFrame(rows, "key string, page int, status string, text string")).collect()}
    assert got == {"d": ("ready", "one\n\ntwo"), "e": ("partial", None), "f": ("ready", "")}
    made = spark.range(1).select(pages.page_result(F.lit("few"), F.lit("few"), F.expr("cast(array() as array<struct<text:string>>)")).alias("p")).first()["p"]
    assert (made["method"], made["text"], made["warnings"]) == ("ocr", "few", ["PDF_EMBEDDED_TEXT_SPARSE", "PDF_PAGE_OCR_FALLBACK"])


def test_image_hash(spark):
    ramp = np.repeat(np.arange(90, 0, -1, dtype=np.uint8)[None], 80, 0)[..., None].repeat(3, 2)
    assert images.hash_of(ramp) == "f" * 16 and images.hash_of(ramp[:, ::-1]) == "0" * 16
    assert images.hash_of(images.oriented(ramp, 2)) == "0" * 16
    cells = images.grid(ramp).reshape(-1).tolist()
    assert spark.range(1).select(images.grid_hash(F.array(*map(F.lit, cells))).alias("h")).first()["h"] == "f" * 16


def test_privacy(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.com or 10.0.0.1"), (2, "card 4111 1111 1111 1111 not 4111 1111 1111 1112"), (3, "clean"), (4, None), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["category"], r["start"], r["length"]) for r in privacy.findings(docs).collect()}
    assert got == {(1, "email", 5, 15), (1, "ip-address", 24, 8), (2, "payment-card", 5, 19)}
    red = {r["doc_id"]: r["t"] for r in docs.select("doc_id", privacy.redact(F.col("text")).alias("t")).collect()}
    assert red[1] == "mail [REDACTED_EMAIL] or [REDACTED_IP_ADDRESS]" and red[2] == "card [REDACTED_PAYMENT_CARD] not 4111 1111 1111 1112" and red[3] == "clean" and red[4] is None


def test_markdown(spark):
    rows = [("p", 2, "Same", "b", "prose"), ("p", 1, "Same", "x = '```'", "code")]
    text = privacy.markdown(spark.createDataFrame(rows, "pack_id string, sort_index long, title string, text string, kind string")).first()["markdown"]
    assert text == "# p\n\n- [Same](#same)\n- [Same](#same-1)\n\n## Same\n\n````\nx = '```'\n````\n\n## Same\n\nb\n"


ID = "0190a3d2-1111-4222-8333-444455556666"


def manifest(**changes):
    item = {"id": ID, "order": 0, "mediaType": "text/plain", "status": "copied", "byteCount": 3, "relativePath": f"{ID}.bin"}
    return {"schemaVersion": 1, "ingestionId": ID, "createdAt": "2024-02-29T10:00:00Z", "source": "main-app-text", "status": "complete", "items": [item]} | changes


@pytest.mark.parametrize(
    "value, error",
    [
        (manifest(), None),
        (manifest(schemaVersion=2), "SCHEMA_VERSION_UNSUPPORTED"),
        (manifest(createdAt="2023-02-29T10:00:00Z"), "SCHEMA_INVALID"),
        (manifest(status="partial"), "SCHEMA_INVALID"),
        (manifest(items=[]), "SCHEMA_INVALID"),
        (manifest(extra=1), "SCHEMA_INVALID"),
        ({}, "SCHEMA_INVALID"),
    ],
)
def test_manifest(spark, value, error):
    got = spark.range(1).select(contracts.decode(F.lit(json.dumps(value)), contracts.MANIFEST, contracts.valid_manifest).alias("d")).first()["d"]
    assert got["error_code"] == error


def test_checkpoint_and_events(spark):
    base = {"schemaVersion": 1, "id": ID, "runId": ID, "packId": ID, "stage": "extract", "reason": "recovery", "resumeAction": "recover-stage", "completedArtifactIds": [], "processor": "p", "processorVersion": "1", "updatedAt": "2024-01-01T00:00:00Z", "errorCode": "PDF_CORRUPT"}
    check = lambda v: spark.range(1).select(contracts.decode(F.lit(json.dumps(v)), contracts.CHECKPOINT, contracts.valid_checkpoint)["error_code"].alias("e")).first()["e"]
    assert check(base) is None and check(base | {"reason": "periodic"}) == "SCHEMA_INVALID"
    assert contracts.error_catalog(spark).count() == 38


def test_leases_and_blockers(spark):
    rows = [("k", 1, 0, "a", "claim", 100), ("k", 2, 50, "b", "claim", 100), ("k", 3, 60, "a", "renew", 100), ("k", 4, 160, "b", "claim", 100), ("k", 5, 170, "a", "renew", 100)]
    got = {r["seq"]: (r["granted"], r["claim_version"]) for r in E.leases(spark.createDataFrame(rows, "key string, seq long, at_ms long, session string, action string, ttl_ms long")).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 1), 4: (True, 2), 5: (False, 2)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 1, "failed", "X"), ("a", 2, "complete", None), ("b", 1, "failed", "X"), ("b", 2, "failed", "Y"), ("b", 3, "failed", "X")]
    batch = spark.createDataFrame(rows, "key string, seq long, result string, code string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    E.blockers(stream).writeStream.format("memory").queryName("blocked").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("blocked").collect())) == sorted(map(tuple, E.blockers(batch).collect())) == [("a", False, None, 0), ("b", True, "X", 2)]


def test_inbox_is_idempotent(spark, tmp_path):
    inbox, target = tmp_path / "inbox", f"file://{tmp_path}/table"
    for i, value in enumerate([manifest(), manifest(schemaVersion=9), manifest()]):
        (inbox / str(i)).mkdir(parents=True)
        (inbox / str(i) / "manifest.json").write_text(json.dumps(value))
    for _ in range(2):
        rows = E.read_manifests(spark, str(inbox / "*" / "manifest.json"))
        E.commit_imports(target)(rows, 0)
    assert [r["ingestion_id"] for r in spark.read.parquet(target).collect()] == [ID]
