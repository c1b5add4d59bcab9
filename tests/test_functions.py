from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import normalize as N
from quirework.functions import sketch as S
from quirework.functions import text as T
from quirework.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lengths(spark):
    assert one(spark, T.utf16_units(F.lit("a\U0001f600"))) == 3
    assert one(spark, T.utf8_bytes(F.lit("é"))) == 2


@pytest.mark.parametrize(
    "text, done, warnings",
    [
        ("plain", "plain", []),
        ("﻿a\r\nb\rc", "a\nb\nc", ["TEXT_BOM_REMOVED", "TEXT_LINE_ENDINGS_NORMALIZED"]),
        ("a\x00b‮", "a�b�", ["TEXT_UNSAFE_CONTROL_REPLACED"]),
        ("", "", []),
    ],
)
def test_plain_text(spark, text, done, warnings):
    got = one(spark, T.plain_text(F.lit(text)))
    assert (got["text"], got["warnings"], got["error_code"]) == (done, warnings, None)


def test_plain_text_errors(spark):
    assert one(spark, T.plain_text(F.lit(None).cast("string")))["error_code"] == "TEXT_INVALID_UTF8"
    assert one(spark, T.plain_text(F.lit("abc"), F.lit(4)))["error_code"] == "TEXT_INVALID_UTF8"
    assert one(spark, T.plain_text(F.repeat(F.lit("a"), 1_048_577)))["error_code"] == "TEXT_TOO_LARGE"


KINDS = [
    ("The quick brown fox.\nJumps over it.", "prose"),
    ("const x = 1;\nreturn f(x);", "code"),
    ("key: 'v'\nother: 12", "code"),
    ("```\nx\n```", "code"),
    ("words\n```\nx\n```", "mixed"),
    ("```\nx\n~~~\nstill inside", "code"),
    ("````\n```\n````\nout", "mixed"),
    ("  indented\n  lines", "code"),
    ("", "prose"),
    ('{"a": 1}', "code"),
    ("one\ntwo\nthree\nx = 1", "prose"),
]


@pytest.mark.parametrize("text, kind", KINDS)
def test_content_kind(spark, text, kind):
    assert one(spark, T.content_kind(F.lit(text))) == kind == N.kind_of(text)


@pytest.mark.parametrize(
    "text, done, kind, warnings",
    [
        ("soft­ly  spaced \n", "softly spaced\n", "prose", ["OCR_ARTIFACT_REMOVED", "PROSE_WHITESPACE_NORMALIZED"]),
        ("exam-\nple", "example", "prose", ["WRAPPED_WORD_REJOINED"]),
        ("a-\na-\na-\na-", "aaaa-", "prose", ["WRAPPED_WORD_REJOINED"]),
        ("ﬁne", "fine", "prose", ["UNICODE_NORMALIZED"]),
        ("a\n\n\n\nb", "a\n\nb", "prose", ["REPEATED_BLANK_LINES_COLLAPSED"]),
        (" \n ", "", "prose", ["PROSE_WHITESPACE_NORMALIZED"]),
        ("﻿x = 1;\r\ny = 2;", "﻿x = 1;\ny = 2;", "code", ["LINE_ENDINGS_NORMALIZED"]),
        ("```\n  keep  this\n```\n\n\nwords", "```\n  keep  this\n```\n\nwords", "mixed", ["REPEATED_BLANK_LINES_COLLAPSED"]),
    ],
)
def test_normalize(text, done, kind, warnings):
    assert N.normalize(text) == (done, kind, warnings)


def test_normalized_column(spark):
    rows = spark.createDataFrame([("x-\ny",), (None,)], "t string").select(N.normalized(F.col("t")).alias("n")).select("n.*").collect()
    assert [(r["text"], r["error_code"]) for r in rows] == [("xy", None), (None, "TEXT_INVALID_UTF8")]


def test_fnv():
    assert S.shingle_hashes("abcde").tolist() == [0x749BCF08]


def test_sketch_native_is_sketch(spark):
    rng = random.Random(1)
    texts = ["", "a", "abcd", "abcde", *("".join(rng.choice("abc é") for _ in range(rng.randrange(400))) for _ in range(30))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.sketch(F.col("t")).alias("a"), S.sketch_native(F.col("t")).alias("b")).collect()
    assert all(list(r["a"]) == list(r["b"]) == S.sketch_of(r["t"]).tolist() for r in rows)


def test_similarity(spark):
    array = lambda *v: F.array(*[F.lit(x).cast("long") for x in v]) if v else F.expr("cast(array() as array<bigint>)")
    assert one(spark, S.similarity(array(1, 2, 3), array(2, 3, 4))) == 0.5
    assert one(spark, S.similarity(array(), array(1))) == 0
    assert one(spark, S.hash_distance(S.hash_bits(F.lit("ffffffffffffffff")), S.hash_bits(F.lit("00000000000000ff")))) == 56


def test_fold(spark):
    assert one(spark, S.fold(F.lit("  A \t B "), F.lit("prose"))) == "a b"
    assert one(spark, S.fold(F.lit(" A  B"), F.lit("code"))) == " A  B"


@pytest.mark.parametrize(
    "url, display, error",
    [
        ("https://u:p@Ex.com/a?k=v&flag#frag", "https://[REDACTED]@ex.com/a?k=[REDACTED]&[REDACTED]#[REDACTED]", None),
        ("http://a.b", "http://a.b/", None),
        ("https://a.b:443/x", "https://a.b/x", None),
        ("ftp://a.b", None, "URL_INVALID"),
        (" http://a.b", None, "URL_INVALID"),
        ("", None, "URL_INVALID"),
        (None, None, "URL_INVALID"),
        ("http://a.b/" + "x" * 70_000, None, "URL_TOO_LONG"),
    ],
)
def test_url(spark, url, display, error):
    got = spark.createDataFrame([(url,)], "u string").select(U.extract_url(F.col("u")).alias("x")).first()["x"]
    assert (got["display"], got["error_code"]) == (display, error)


def test_paths_and_types(spark):
    for path, ok in (("a/b.txt", True), ("../a", False), ("/a", False), ("a//b", False), (".hidden", False), ("a/./b", False)):
        assert one(spark, U.is_safe_path(F.lit(path))) is ok
    assert one(spark, U.bounded_media_type(F.lit("Image/PNG"))) == "image/png"
    assert one(spark, U.bounded_media_type(F.lit("nonsense"))) == "application/octet-stream"
    for content, kind in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"%PDF-1.7", "application/pdf"), (b"\x00\x00\x00\x18ftypheic", "image/heic"), (b"hello", "text/plain"), (b"https://a.b/", "text/uri-list"), (b"\xff\xfe\x00", None)):
        assert one(spark, U.sniffed_type(F.lit(bytearray(content)))) == kind
    assert one(spark, U.compatible(F.lit("image/*"), F.lit("image/png"))) and not one(spark, U.compatible(F.lit("image/png"), F.lit("image/gif")))
