"""Plain-text operators as column expressions: lengths, cleaning, and the kind of a text's content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Controls that texts must not hold, as members of a character class.
UNSAFE = r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
#: What counts as white space, as members of a character class.
BLANK = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: What page density leaves out as white space.
DENSITY_BLANK = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BOM = "﻿"
MAX_PLAIN_BYTES = 1_048_576
#: Assignment operators, and words that begin a line of code.
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", "@=", ":=", "??=", "&&=", "||=", "<<=", ">>=", ">>>=", "**=")
CODE_WORDS = ("const", "let", "var", "func", "class", "interface", "type", "import", "export", "def", "fun", "if", "for", "while")
#: Share of lines with a sign of code from which a text without fences is code.
CODE_SHARE = 0.34


def escaped(s: str) -> str:
    """s with the characters that patterns give a meaning escaped."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in s)


_S = f"[{BLANK}]"
FENCE = rf"^{_S}*(`{{3,}}|~{{3,}})"
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Signs of code, each searched for in a line.
SIGNALS = (
    rf"^{_S}*(?:export{_S}+)?[A-Za-z_$][A-Za-z0-9_.$\[\]'-]*{_S}*(?:{'|'.join(map(escaped, ASSIGNMENTS))}){_S}*[^{BLANK}]",
    rf"(?i)^{_S}*[A-Za-z_][A-Za-z0-9_.-]*{_S}*:{_S}*(?:[\"'\[{{]|[-+]?[0-9]|true\b|false\b|null\b)",
    rf"^{_S}*(?:(?:await|return|yield|throw){_S}+(?:new{_S}+)?|(?:raise|new){_S}+)?{_NAME}(?:\??\.{_NAME})*{_S}*\([^\r\n\x{{2028}}\x{{2029}}]*\){_S}*;?{_S}*$",
    rf"=>|::|[;{{}}]{_S}*$|^{_S}*(?:{'|'.join(CODE_WORDS)})\b",
)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def utf16_units(text: Column) -> Column:
    """The length of a text in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def one_line_ends(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def page_text(text: Column) -> Column:
    """A page's text: line ends unified, unsafe controls replaced; a byte order mark stays."""
    return F.regexp_replace(one_line_ends(text), f"[{UNSAFE}]", "�")


def density(text: Column) -> Column:
    """UTF-16 units that are not white space."""
    return utf16_units(F.regexp_replace(text, f"[{DENSITY_BLANK}]+", ""))


def plain_text(text: Column, declared_bytes: Column | None = None) -> Column:
    """struct<text, byte_count, character_count, warnings, error_code>: a cleaned plain text.

    Bytes are those before cleaning. A text whose bytes are not as declared, or too many, has an error code and no text.
    """
    size = utf8_bytes(text)
    declared = size if declared_bytes is None else F.coalesce(declared_bytes, size)
    error = F.when(declared > MAX_PLAIN_BYTES, "TEXT_TOO_LARGE").when(text.isNull() | (declared != size), "TEXT_INVALID_UTF8")
    bare = F.regexp_replace(text, f"^{BOM}", "")
    clean = page_text(bare)
    warnings = F.array_compact(F.array(
        F.when(text.startswith(BOM), F.lit("TEXT_BOM_REMOVED")),
        F.when(F.contains(text, F.lit("\r")), F.lit("TEXT_LINE_ENDINGS_NORMALIZED")),
        F.when(one_line_ends(bare).rlike(f"[{UNSAFE}]"), F.lit("TEXT_UNSAFE_CONTROL_REPLACED")),
    ))
    ok = error.isNull()
    return F.struct(F.when(ok, clean).alias("text"), F.when(ok, size).alias("byte_count"), F.when(ok, utf16_units(clean)).alias("character_count"), F.when(ok, warnings).alias("warnings"), error.alias("error_code"))


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{BLANK}]")


def code_signal(line: Column) -> Column:
    """Whether a line that isn't blank looks like code; indentation alone does."""
    found = line.rlike(f"^[{BLANK}]") | line.rlike(FENCE)
    for pattern in SIGNALS:
        found = found | line.rlike(pattern)
    return ~is_blank(line) & found


def content_kind(text: Column) -> Column:
    """prose, code or mixed. Text with fences is mixed if a line outside of them isn't blank."""
    lines = F.split(F.regexp_replace(one_line_ends(text), f"^{BOM}", ""), "\n", -1)
    meaningful = F.filter(lines, lambda x: ~is_blank(x))
    signals = F.size(F.filter(meaningful, code_signal))
    # The open fence's marks, or '' outside; whether a line outside of fences isn't blank.
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("outside"))

    def step(state: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, FENCE, 1)
        trimmed = F.regexp_replace(line, f"^[{BLANK}]+|[{BLANK}]+$", "")
        opened, fence = state["open"] != "", marks != ""
        closes = opened & (trimmed == marks) & (F.substring(marks, 1, 1) == F.substring(state["open"], 1, 1)) & (F.length(marks) >= F.length(state["open"]))
        now = F.when(closes, F.lit("")).when(~opened & fence, marks).otherwise(state["open"])
        return F.struct(now.alias("open"), (state["outside"] | (~opened & ~fence & ~is_blank(line))).alias("outside"))

    outside = F.aggregate(lines, start, step)["outside"]
    fenced = F.exists(lines, lambda x: x.rlike(FENCE))
    return F.when(fenced, F.when(outside, "mixed").otherwise("code")).when((signals > 0) & (signals / F.greatest(F.size(meaningful), F.lit(1)) >= CODE_SHARE), "code").otherwise("prose")


def collapse_lines(text: Column) -> Column:
    """Each line's runs of tabs and spaces as one space, its ends trimmed, and at most one blank line in a row."""
    lines = F.split(one_line_ends(text), "\n", -1)
    trimmed = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "[\t ]+", " "), f"^[{BLANK}]+|[{BLANK}]+$", ""))
    return F.regexp_replace(F.array_join(trimmed, "\n"), "\n{3,}", "\n\n")


def rejoin_words(text: Column) -> Column:
    """Words that a line end broke after a hyphen, whole again."""
    return F.regexp_replace(text, r"-\n(?=\p{Ll})", "")
