"""Findings of personal data and secrets in texts, their redaction, size estimates and Markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The pattern of each category, in order of precedence where findings begin at one place.
PATTERNS = {
    "private-key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "bearer-token": r"\b[Bb]earer +[A-Za-z0-9._~+/-]{16,}=*",
    "api-key": r"\b(?:AKIA[0-9A-Z]{16}|sk_(?:live|test)_[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{36})\b",
    "url-credential": r"\bhttps?://[^\s/?#@:]+:[^\s/?#@]+@",
    "email": r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}\b",
    "ip-address": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b|\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "payment-card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}\b",
}
#: A token is about so many UTF-8 bytes; version 1 of our own estimate.
BYTES_PER_TOKEN = 4
#: The share of the estimate that each preset keeps.
PRESETS = {"quality": 1.0, "balanced": 0.6, "compact": 0.3}


def luhn(number: Column) -> Column:
    """Whether a number's digits, others left out, have a right check digit."""
    digits = F.filter(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2 % 10 + F.floor(d.cast("int") * 2 / 10)).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def spans(text: Column, category: str) -> Column:
    """array<struct<start, length, value>> of a category, start in code points from 0. Matches follow each other from the text's start."""
    pattern = PATTERNS[category]
    found = F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))).otherwise(F.array())
    cut = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), F.regexp_extract(m, f"({pattern})$", 1).alias("value")))
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int,value:string>>))")
    step = lambda a, m: F.struct((a["at"] + m["n"]).alias("at"), F.concat(a["spans"], F.array(F.struct((a["at"] + m["n"] - F.length(m["value"])).alias("start"), F.length(m["value"]).alias("length"), m["value"].alias("value")))).alias("spans"))
    out = F.aggregate(cut, empty, step, lambda a: a["spans"])
    return F.filter(out, lambda s: luhn(s["value"])) if category == "payment-card" else out


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, category, start, length, confidence of whole texts. Kinds with many false positives have half the confidence."""
    every = F.array(*[F.struct(F.lit(c).alias("category"), spans(F.col("text"), c).alias("spans"), F.lit(0.5 if c in ("payment-card", "ip-address", "phone") else 1.0).alias("confidence")) for c in PATTERNS])
    rows = docs.select("doc_id", F.explode(every).alias("c")).select("doc_id", "c.category", "c.confidence", F.explode("c.spans").alias("s"))
    return rows.select("doc_id", "category", "s.start", "s.length", "confidence")


def all_spans(text: Column) -> Column:
    """array<struct<start, length, category>>: what findings cover, in order and without overlap.

    Findings that overlap are one stretch, from the first one's start to the last one's end, of the category of the one
    that starts first (of such that start together the longest, then by the order of PATTERNS).
    """
    own = [F.transform(spans(text, c), lambda s: F.struct(s["start"].alias("start"), (-s["length"]).alias("minus"), F.lit(i).alias("rank"), F.lit(c).alias("category"))) for i, c in enumerate(PATTERNS)]  # noqa: B023
    every = F.array_sort(F.concat(*own))
    empty = F.expr("cast(array() as array<struct<start:int,length:int,category:string>>)")

    def step(kept: Column, s: Column) -> Column:
        last, end = F.element_at(kept, -1), s["start"] - s["minus"]
        stretch = F.struct(last["start"].alias("start"), F.greatest(last["length"], end - last["start"]).alias("length"), last["category"].alias("category"))
        fresh = F.struct(s["start"].alias("start"), (-s["minus"]).alias("length"), s["category"].alias("category"))
        overlaps = (F.size(kept) > 0) & (s["start"] < last["start"] + last["length"])
        return F.when(overlaps, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(stretch))).otherwise(F.concat(kept, F.array(fresh)))

    return F.aggregate(every, empty, step)


def redact(text: Column, keep: Column | None = None) -> Column:
    """text with every stretch of findings replaced by the name of its category.

    keep: array<string> of what stays as it is: a category, or "category:start" for one stretch. Marks that are in the
    text already match no pattern. The new text is put together once, from what lies between stretches.
    """
    found = all_spans(text)
    if keep is not None:
        kept = F.coalesce(keep, F.array().cast("array<string>"))
        found = F.filter(found, lambda s: ~F.array_contains(kept, s["category"]) & ~F.array_contains(kept, F.concat_ws(":", s["category"], s["start"].cast("string"))))
    ends = lambda f: F.concat(F.array(F.lit(0)), F.transform(f, lambda s: s["start"] + s["length"]))
    mark = lambda s: F.concat(F.lit("[REDACTED_"), F.upper(F.replace(s["category"], F.lit("-"), F.lit("_"))), F.lit("]"))
    # An array of one holds the stretches, so that they are found once.
    made = F.transform(F.array(found), lambda f: F.concat(
        F.array_join(F.zip_with(f, F.slice(ends(f), F.lit(1), F.size(f)), lambda s, b: F.concat(text.substr(b + 1, s["start"] - b), mark(s))), ""),
        text.substr(F.element_at(ends(f), -1) + 1, F.length(text)),
    ))
    return F.get(made, F.lit(0))


def token_estimate(text: Column, preset: str = "quality") -> Column:
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN * PRESETS[preset]).cast("long")


def fence_for(text: Column) -> Column:
    """A fence longer than any run of backticks in text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def markdown(items: DataFrame) -> DataFrame:
    """items (pack_id, sort_index, title, text, kind) to pack_id, markdown: a heading, contents with unique links, and each item in order.

    Code is fenced. Links of equal titles get numbers. A pack's items make one document, so they meet in one row.
    """
    rows = items.select("pack_id", "sort_index", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "kind")
    lists = rows.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("sort_index", "title", "text", "kind"))).alias("i"))
    slugs = F.transform("i", lambda x: slug(x["title"]))
    lists = lists.withColumn("s", slugs)
    unique = F.transform("s", lambda x, i: F.concat(x, F.when(F.size(F.filter(F.slice("s", F.lit(1), i), lambda y: y == x)) > 0, F.concat(F.lit("-"), F.size(F.filter(F.slice("s", F.lit(1), i), lambda y: y == x)).cast("string"))).otherwise(F.lit(""))))
    contents = F.array_join(F.zip_with("i", unique, lambda x, s: F.concat(F.lit("- ["), x["title"], F.lit("](#"), s, F.lit(")"))), "\n")
    body = F.array_join(F.transform("i", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), F.when(x["kind"] == "code", F.concat(fence_for(x["text"]), F.lit("\n"), x["text"], F.lit("\n"), fence_for(x["text"]))).otherwise(x["text"]))), "\n\n")
    return lists.select("pack_id", F.concat(F.lit("# "), F.col("pack_id").cast("string"), F.lit("\n\n"), contents, F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def bundle(items: DataFrame) -> DataFrame:
    """items (pack_id, sort_index, title, extension, byte_count, sha256) to the files of each pack's bundle, in order: a name
    that no other file of it has, and what an export's manifest says of it.

    A name is the place and the title's slug, so equal titles and titles without a letter differ by place.
    """
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy("sort_index", "title", "sha256"))
    name = F.concat_ws("-", F.lpad(place.cast("string"), 4, "0"), F.nullif(slug(F.coalesce("title", F.lit(""))), F.lit("")))
    return items.select("pack_id", place.cast("long").alias("place"), F.concat(F.lit("attachments/"), name, F.lit("."), "extension").alias("relative_path"), "byte_count", "sha256")
