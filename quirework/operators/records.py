"""Contracts of further records: capabilities, pages, files, analyses, suggestions, decisions, log lines and what a file store reports.

Each is a schema and a predicate over a struct of it; with contracts.decode they tell another version's payload from an
invalid one. Records of a file store have no version, so their predicate alone says whether they are valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import density, utf16_units
from quirework.functions.urls import UUID, is_web_url, parse_owned_path
from quirework.operators import contracts as C
from quirework.operators.pages import MOST_BLOCK_UNITS, MOST_BLOCKS, MOST_UNITS, reading_order

#: Limits, versions and members of enumerations.
MOST_PAGES, MOST_PDF_BYTES, MOST_TEXT_BYTES, MOST_DERIVED_BYTES, MOST_INPUTS = 25, 52_428_800, 1_048_576, 16_777_216, 20
PAGE_WARNINGS = ("PDF_EMBEDDED_TEXT_SPARSE", "PDF_PAGE_OCR_FALLBACK", "PDF_PAGE_EMPTY", "PDF_PAGE_EXTRACTION_FAILED")
TEXT_WARNINGS = ("UNICODE_NORMALIZED", "LINE_ENDINGS_NORMALIZED", "OCR_ARTIFACT_REMOVED", "PROSE_WHITESPACE_NORMALIZED", "REPEATED_BLANK_LINES_COLLAPSED", "WRAPPED_WORD_REJOINED")
DETECTOR = {"schemaVersion": 1, "exactBinaryAlgorithm": "sha256", "normalizationVersion": "text-normalization-v1", "textFingerprintAlgorithm": "bottom-k-fnv1a32-5gram-v1", "textSimilarityThreshold": 0.82, "imageFingerprintAlgorithm": "dhash-64-v1", "imageHammingDistanceThreshold": 8, "minimumTextCharacters": 20}
LOG_EVENTS = ("inbox_scan", "import_completed", "import_failed", "ocr_completed", "pdf_probe_completed")
LOG_CODES = ("INBOX_SCAN_FAILED", "NATIVE_ADAPTER_UNAVAILABLE", "NATIVE_MANIFEST_INVALID", "NATIVE_OCR_RESULT_INVALID", "NATIVE_PDF_RESULT_INVALID", "OCR_IMAGE_DECODE_FAILED", "OCR_RECOGNITION_FAILED", "SHARE_COPY_FAILED", "SHARE_IMPORT_FAILED", "SHARE_IMPORT_EVENT_INVALID")
LOG_ENGINES = ("apple-vision", "ml-kit-latin", "ml-kit-chinese", "pdfkit", "pdf-renderer")
LOG_KEYS = ("code", "count", "bytes", "durationMs", "version", "engine", "anonymousId")
MOST_SAFE = 2**53 - 1

_BLOCKS = "array<struct<text:string,bounds:struct<x:double,y:double,width:double,height:double>,confidence:double,language:string>>"
_PRINT = "struct<schemaVersion:int,algorithm:string,shingleSize:int,sampleSize:int,similarityCharacterCount:bigint,shingleCount:bigint,hashes:array<string>>"
_HASH = "struct<schemaVersion:int,algorithm:string,hash:string,sampleWidth:int,sampleHeight:int,orientationApplied:boolean,durationMs:double,revision:string>"
CAPABILITIES = "schemaVersion int, engines array<struct<engine:string,revision:string,scripts:array<string>,recognitionLevels:array<string>,ready:boolean,offline:boolean>>, maximumPixelCount bigint, maximumDimension bigint"
PAGE = f"schemaVersion int, pageIndex bigint, method string, engine string, revision string, durationMs double, status string, text string, blocks {_BLOCKS}, characterCount bigint, warnings array<string>, embeddedText string, errorCode string"
PDF_INFO = "schemaVersion int, pageCount bigint, byteCount bigint, sha256 string, engine string, revision string, limit struct<pages:int,bytes:bigint>"
TEXT_FILE = "schemaVersion int, text string, byteCount bigint, encoding string, revision string"
NORMALIZED = "schemaVersion int, normalizationVersion string, contentKind string, text string, characterCount bigint, utf8ByteCount bigint, warnings array<string>"
IMAGE_HASH = _HASH
ANALYSIS = f"schemaVersion int, packId string, itemId string, originalSha256 string, originalByteCount bigint, normalizedArtifactId string, normalizedSha256 string, normalizedByteCount bigint, normalizedCharacterCount bigint, contentKind string, textFingerprint {_PRINT}, imageFingerprint {_HASH}, analyzedAt string"
SUGGESTION = "schemaVersion int, key string, packId string, leftItemId string, rightItemId string, reason string, confidence double, expectedBytesSaved bigint, expectedCharactersSaved bigint"
ANALYSIS_MANIFEST = "schemaVersion int, packId string, config struct<schemaVersion:int,exactBinaryAlgorithm:string,normalizationVersion:string,textFingerprintAlgorithm:string,textSimilarityThreshold:double,imageFingerprintAlgorithm:string,imageHammingDistanceThreshold:int,minimumTextCharacters:int>, analyzedAt string, itemCount bigint, suggestionCount bigint"
DECISION = "schemaVersion int, packId string, itemId string, choice string, baselineInclusionMode string, source string, decidedAt string"
LOG = "event string, code string, count double, bytes double, durationMs double, version string, engine string, anonymousId string"
HANDOFF = "id string, itemId string, relativePath string, mediaType string, byteCount bigint, sha256 string"
VERIFICATION = "relativePath string, status string, byteCount bigint, sha256 string"
QUARANTINED = "quarantined boolean, quarantineId string, anonymousId string, byteCount bigint"
IMPORT_INPUT = "ingestionId string, source string, inputs array<struct<id:string,order:int,kind:string,declaredMediaType:string,byteCount:bigint,text:string,fileUri:string,ownedRelativePath:string,sha256:string>>"

yes, all_of, distinct = C.yes, C.all_of, C.distinct


def count(c: Column) -> Column:
    return yes(c.between(0, MOST_SAFE))


def unique_of(values: Column, members: tuple[str, ...]) -> Column:
    return all_of(values, lambda x: x.isin(*members)) & distinct(values)


def is_owned_path(path: Column, area: str | None = None) -> Column:
    parts = parse_owned_path(path)
    return yes(parts.isNotNull() & ~parts["partial"] & (F.lit(True) if area is None else parts["area"] == area))


def valid_capabilities(c: Column) -> Column:
    """One to three engines, each once, that work offline."""
    engine = lambda e: e["engine"].isin(*C.ENGINES) & (e["revision"] != "") & unique_of(e["scripts"], ("latin", "chinese")) & (F.size(e["recognitionLevels"]) > 0) & unique_of(e["recognitionLevels"], ("accurate", "fast")) & e["ready"].isNotNull() & e["offline"]
    return yes((c["schemaVersion"] == 1) & F.size(c["engines"]).between(1, 3) & all_of(c["engines"], engine) & distinct(F.transform(c["engines"], lambda e: e["engine"])) & (c["maximumPixelCount"] > 0) & (c["maximumDimension"] > 0))


def script_of(c: Column) -> Column:
    """chinese where a ready engine reads it, else latin, else null."""
    reads = lambda script: F.exists(c["engines"], lambda e: yes(e["ready"]) & yes(F.array_contains(e["scripts"], script)))
    return F.when(reads("chinese"), "chinese").when(reads("latin"), "latin")


def in_reading_order(blocks: Column) -> Column:
    """Whether blocks are as reading_order would have them."""
    flat = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), *[b["bounds"][k].alias(k) for k in ("x", "y", "width", "height")]))
    return yes(reading_order(flat) == flat)


def valid_page(p: Column) -> Column:
    """A page that is complete, with a text that its blocks and its sparse embedded text make, or failed with a code."""
    method = F.when(p["method"] == "embedded-text", p["engine"].isin("pdfkit", "pdf-renderer")).when(p["method"] == "rendered-ocr", p["engine"].isin("apple-vision", "ml-kit"))
    warnings = p["warnings"].isNull() | unique_of(p["warnings"], PAGE_WARNINGS)
    common = (p["schemaVersion"] == 1) & count(p["pageIndex"]) & yes(method) & (p["revision"] != "") & (p["durationMs"] >= 0) & (p["durationMs"] < float("inf")) & warnings
    block = lambda b: b["text"].isNotNull() & (utf16_units(b["text"]) <= MOST_BLOCK_UNITS) & C.in_bounds(b["bounds"]) & (b["confidence"].isNull() | b["confidence"].between(0, 1))
    seen = F.array_join(F.transform(p["blocks"], lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    own = p["embeddedText"]
    sparse = own.isNull() | ((p["method"] == "rendered-ocr") & (utf16_units(own) <= MOST_UNITS) & F.array_contains(p["warnings"], "PDF_EMBEDDED_TEXT_SPARSE") & density(own).between(1, 15))
    made = F.when(own.isNull() | (own == ""), seen).when((seen == "") | (seen == own), own).otherwise(F.concat(own, F.lit("\n"), seen))
    text = F.when(p["method"] == "embedded-text", F.size(p["blocks"]) == 0).otherwise(made == p["text"])
    counted = p["characterCount"].isNull() | (p["characterCount"] == utf16_units(p["text"]))
    complete = (p["status"] == "complete") & (utf16_units(p["text"]) <= MOST_UNITS) & counted & (F.size(p["blocks"]) <= MOST_BLOCKS) & all_of(p["blocks"], block) & (utf16_units(seen) <= MOST_UNITS) & yes(sparse) & in_reading_order(p["blocks"]) & yes(text) & p["errorCode"].isNull()
    failed = (p["status"] == "failed") & p["errorCode"].isin(*C.CODES) & p["text"].isNull() & p["blocks"].isNull() & own.isNull() & (F.coalesce(p["characterCount"], F.lit(0)) == 0)
    return yes(common & (yes(complete) | yes(failed)))


def valid_pdf_info(i: Column) -> Column:
    limit = (i["limit"]["pages"] == MOST_PAGES) & (i["limit"]["bytes"] == MOST_PDF_BYTES)
    return yes((i["schemaVersion"] == 1) & i["pageCount"].between(1, MOST_PAGES) & i["byteCount"].between(0, MOST_PDF_BYTES) & C.is_sha256(i["sha256"]) & i["engine"].isin("pdfkit", "pdf-renderer") & (i["revision"] != "") & limit)


def valid_text_file(t: Column, most_bytes: int = MOST_TEXT_BYTES) -> Column:
    size = t["byteCount"].between(0, min(most_bytes, MOST_DERIVED_BYTES)) & (t["byteCount"] == F.octet_length(t["text"]))
    return yes((t["schemaVersion"] == 1) & size & (t["encoding"] == "utf-8") & (t["revision"] == "1"))


def valid_normalized(n: Column) -> Column:
    sizes = (n["characterCount"] == utf16_units(n["text"])) & (n["utf8ByteCount"] == F.octet_length(n["text"]))
    return yes((n["schemaVersion"] == 1) & (n["normalizationVersion"] == DETECTOR["normalizationVersion"]) & n["contentKind"].isin("prose", "code", "mixed") & sizes & unique_of(n["warnings"], TEXT_WARNINGS))


def valid_text_print(f: Column) -> Column:
    kind = (f["schemaVersion"] == 1) & (f["algorithm"] == DETECTOR["textFingerprintAlgorithm"]) & (f["shingleSize"] == 5) & (f["sampleSize"] == 128)
    return yes(kind & C.valid_fingerprint(f))


def valid_image_hash(h: Column) -> Column:
    grid = (h["sampleWidth"] == 9) & (h["sampleHeight"] == 8) & h["orientationApplied"]
    return yes((h["schemaVersion"] == 1) & (h["algorithm"] == DETECTOR["imageFingerprintAlgorithm"]) & h["hash"].rlike("^[0-9a-f]{16}$") & grid & (h["durationMs"] >= 0) & (h["durationMs"] < float("inf")) & (h["revision"] == "1"))


def valid_analysis(a: Column) -> Column:
    n, own = a["normalizedCharacterCount"], a["textFingerprint"]["similarityCharacterCount"]
    sizes = F.when(n == 0, (a["normalizedByteCount"] == 0) & (own == 0)).otherwise((a["normalizedByteCount"] >= n) & own.between(1, a["normalizedByteCount"]))
    ids = C.is_uuid(a["packId"]) & C.is_uuid(a["itemId"]) & C.is_uuid(a["normalizedArtifactId"]) & C.is_sha256(a["normalizedSha256"]) & (a["originalSha256"].isNull() | C.is_sha256(a["originalSha256"]))
    parts = valid_text_print(a["textFingerprint"]) & (a["imageFingerprint"].isNull() | valid_image_hash(a["imageFingerprint"]))
    return yes((a["schemaVersion"] == 1) & ids & count(a["originalByteCount"]) & count(a["normalizedByteCount"]) & count(n) & a["contentKind"].isin("prose", "code", "mixed") & parts & yes(sizes) & C.is_instant(a["analyzedAt"]))


def valid_suggestion(s: Column) -> Column:
    ids = C.is_uuid(s["packId"]) & C.is_uuid(s["leftItemId"]) & C.is_uuid(s["rightItemId"]) & (s["leftItemId"] < s["rightItemId"])
    key = s["key"] == F.concat_ws(":", s["reason"], s["leftItemId"], s["rightItemId"])
    return yes((s["schemaVersion"] == 1) & ids & s["reason"].isin("exact-binary", "near-image", "similar-text") & key & s["confidence"].between(0, 1) & count(s["expectedBytesSaved"]) & count(s["expectedCharactersSaved"]))


def valid_analysis_manifest(m: Column) -> Column:
    config = F.lit(True)
    for k, v in DETECTOR.items():
        config = config & (m["config"][k] == v)
    return yes((m["schemaVersion"] == 1) & C.is_uuid(m["packId"]) & config & C.is_instant(m["analyzedAt"]) & count(m["itemCount"]) & count(m["suggestionCount"]))


def valid_decision(d: Column) -> Column:
    source = d["source"].isNull() | d["source"].isin("standalone", "preferred-group")
    return yes((d["schemaVersion"] == 1) & C.is_uuid(d["packId"]) & C.is_uuid(d["itemId"]) & d["choice"].isin("keep", "exclude", "preferred") & d["baselineInclusionMode"].isin("original", "extracted", "both", "excluded") & source & C.is_instant(d["decidedAt"]))


def valid_log(line: Column) -> Column:
    """line: a struct of LOG; only members of fixed sets, plain versions, anonymous ids and numbers may be logged."""
    number = lambda c, whole: c.isNull() | (c.between(0, MOST_SAFE) & ((c == F.floor(c)) if whole else F.lit(True)))
    version = line["version"].isNull() | (line["version"].rlike(r"^[0-9]+(\.[0-9]+){0,3}$") & (F.length(line["version"]) <= 32))
    who = line["anonymousId"].isNull() | line["anonymousId"].rlike(f"^([0-9a-f]{{64}}|{UUID})$")
    codes = (line["code"].isNull() | line["code"].isin(*LOG_CODES)) & (line["engine"].isNull() | line["engine"].isin(*LOG_ENGINES))
    return yes(line["event"].isin(*LOG_EVENTS) & codes & number(line["count"], True) & number(line["bytes"], True) & number(line["durationMs"], False) & version & who)


def log_line(json: Column) -> Column:
    """The line that may be logged of a JSON record, with its keys in a fixed order; null for one that may not."""
    line = F.from_json(json, LOG)
    keys = F.size(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in ("event", *LOG_KEYS)]))) == 0
    whole = lambda c: F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    parts = [F.concat(F.lit('{"event":"'), line["event"], F.lit('"'))]
    for k in LOG_KEYS:
        value = whole(line[k]) if k in ("count", "bytes", "durationMs") else F.concat(F.lit('"'), line[k], F.lit('"'))
        parts.append(F.coalesce(F.concat(F.lit(f',"{k}":'), value), F.lit("")))
    return F.when(yes(keys) & valid_log(line), F.concat(*parts, F.lit("}")))


def valid_handoff(a: Column) -> Column:
    return yes(C.is_uuid(a["id"]) & (a["itemId"] == a["id"]) & is_owned_path(a["relativePath"]) & C.is_media_type(a["mediaType"]) & count(a["byteCount"]) & C.is_sha256(a["sha256"]))


def valid_verification(v: Column) -> Column:
    """A file that is missing has neither size nor hash; any other has both."""
    size = F.when(v["status"] == "missing", v["byteCount"].isNull() & v["sha256"].isNull()).otherwise(count(v["byteCount"]) & C.is_sha256(v["sha256"]))
    return yes(is_owned_path(v["relativePath"]) & v["status"].isin("verified", "missing", "mismatch") & yes(size))


def valid_quarantined(q: Column) -> Column:
    away = C.is_uuid(q["quarantineId"]) & C.is_uuid(q["anonymousId"]) & count(q["byteCount"])
    return yes(F.when(q["quarantined"], away).otherwise(q["quarantineId"].isNull() & q["anonymousId"].isNull() & q["byteCount"].isNull()))


def valid_import_input(m: Column) -> Column:
    """Up to 20 inputs in order, with files from a picker alone, and texts and addresses whose sizes are right."""
    own = lambda x: (x["kind"] == "owned-file") & is_owned_path(x["ownedRelativePath"], "originals") & C.is_sha256(x["sha256"]) & x["text"].isNull() & x["fileUri"].isNull()
    file = lambda x: (x["kind"] == "file") & x["fileUri"].startswith("file://") & x["text"].isNull() & x["ownedRelativePath"].isNull()
    said = lambda x: (x["text"] != "") & (x["byteCount"] <= MOST_TEXT_BYTES) & (x["byteCount"] == F.octet_length(x["text"])) & x["fileUri"].isNull() & x["ownedRelativePath"].isNull()
    text = lambda x: (x["kind"] == "text") & (x["declaredMediaType"] == "text/plain") & said(x)
    url = lambda x: (x["kind"] == "url") & (x["declaredMediaType"] == "text/uri-list") & said(x) & is_web_url(x["text"])
    each = all_of(m["inputs"], lambda x: C.is_uuid(x["id"]) & C.is_media_type(x["declaredMediaType"]) & (F.length(x["declaredMediaType"]) <= 127) & count(x["byteCount"]) & (yes(own(x)) | yes(file(x)) | yes(text(x)) | yes(url(x))))
    ordered = yes(F.forall(F.transform(m["inputs"], lambda x, i: x["order"] == i), lambda ok: yes(ok)))
    picked = F.exists(m["inputs"], lambda x: x["kind"].isin("file", "owned-file"))
    return yes(C.is_uuid(m["ingestionId"]) & m["source"].isin("main-app-picker", "main-app-text") & F.size(m["inputs"]).between(1, MOST_INPUTS) & ((m["source"] == "main-app-picker") == picked) & ordered & distinct(F.transform(m["inputs"], lambda x: x["id"])) & each)


C.KEYS.update({
    CAPABILITIES: (("schemaVersion", "engines", "maximumPixelCount", "maximumDimension"), ()),
    PDF_INFO: (("schemaVersion", "pageCount", "byteCount", "sha256", "engine", "revision", "limit"), ()),
    TEXT_FILE: (("schemaVersion", "text", "byteCount", "encoding", "revision"), ()),
    NORMALIZED: (("schemaVersion", "normalizationVersion", "contentKind", "text", "characterCount", "utf8ByteCount", "warnings"), ()),
    ANALYSIS: (("schemaVersion", "packId", "itemId", "originalByteCount", "normalizedArtifactId", "normalizedSha256", "normalizedByteCount", "normalizedCharacterCount", "contentKind", "textFingerprint", "analyzedAt"), ("originalSha256", "imageFingerprint")),
    SUGGESTION: (("schemaVersion", "key", "packId", "leftItemId", "rightItemId", "reason", "confidence", "expectedBytesSaved", "expectedCharactersSaved"), ()),
    ANALYSIS_MANIFEST: (("schemaVersion", "packId", "config", "analyzedAt", "itemCount", "suggestionCount"), ()),
    DECISION: (("schemaVersion", "packId", "itemId", "choice", "baselineInclusionMode", "decidedAt"), ("source",)),
    IMAGE_HASH: (("schemaVersion", "algorithm", "hash", "sampleWidth", "sampleHeight", "orientationApplied", "durationMs", "revision"), ()),
    PAGE: (("schemaVersion", "pageIndex", "method", "engine", "revision", "durationMs", "status"), ("text", "blocks", "characterCount", "warnings", "embeddedText", "errorCode")),
})
