"""Document fingerprints: Merkle trees over paragraphs and sections."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import id_parts, keys_of_partitions

#: Leaves are paragraphs. A paragraph is cut where a blank follows bytes whose hash is a multiple of this: every few words,
#: wherever in the text they stand. The first bytes of a text are cut finer, so that a short text has leaves too.
CUT, FINE, FINE_BYTES = 8, 2, 512
#: Code points of the largest paragraph, and of the largest that starts in the first bytes. Longer stretches, such as texts
#: without blanks or of one repeated phrase, are cut where the hash of so many code points before is least.
MOST, FINE_MOST, WINDOW = 128, 32, 8
#: A leaf whose hash is a multiple of this ends a section; a section has so many leaves at most.
SECTION, SECTION_MOST = 16, 64
#: Bytes of the hash of the root, of a section and of a leaf.
ROOT, BRANCH, LEAF = 16, 6, 4
#: Documents that one part pairs with their successors, about.
ROWS_PER_TASK = 2_000
#: Characters of fingerprints that a task holds before it gives them away.
MOST_HELD = 4_000_000

_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint32(2_654_435_761)


def _split(stretch: bytes, at: int) -> list[int]:
    """Where the paragraphs of a stretch at a byte of its text end, if it has more code points than one may have.

    Each ends in the last three quarters of what it may have, at the least hash and of equal ones at the last: an edit
    moves few ends after it, and a repeated phrase is always cut at the same place of it.
    """
    points = np.frombuffer(stretch.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    most = FINE_MOST if at < FINE_BYTES else MOST
    if len(points) <= most:
        return [at + len(stretch)]
    bytes_to = at + np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    hashes = points * np.uint32(1)
    for back in range(1, WINDOW):
        hashes[back:] += points[:-back] * np.uint32(pow(257, back, 1 << 32))
    hashes = (hashes ^ (hashes >> np.uint32(15))) * _MIX
    ends, start = [], 0
    while len(points) - start > most:
        after = hashes[start + most // 4 - 1 : start + most]
        start += most - int(after[::-1].argmin())
        ends.append(int(bytes_to[start - 1]))
        most = FINE_MOST if ends[-1] < FINE_BYTES else MOST
    return [*ends, at + len(stretch)]


def _ends(text: bytes, start: int = 0) -> tuple[list[int], np.ndarray]:
    """Where the paragraphs of a text end from a byte on that ends one or is 0: after a newline, after blanks that the
    bytes before choose, and as _split has it; and apart from them the ends of the first two kinds, which only the few
    bytes before them decide."""
    b = np.frombuffer(text, np.uint8)
    blank = np.flatnonzero(_BLANKS[b[start:]]) + start
    before = np.zeros(len(blank), np.uint32)
    for back in (1, 2, 3, 4):
        before = before * np.uint32(257) + np.where(blank >= back, b[np.maximum(blank - back, 0)], 0).astype(np.uint32)
    chosen = ((before * _MIX) >> np.uint32(16)) % np.where(blank < FINE_BYTES, FINE, CUT).astype(np.uint32) == 0
    firm = blank[chosen | (b[blank] == 10)] + 1
    ends = firm if start >= len(b) or (len(firm) and firm[-1] == len(b)) else np.append(firm, len(b))
    starts = np.concatenate(([start], ends))[:-1]
    long = np.flatnonzero(ends - starts > np.where(starts < FINE_BYTES, FINE_MOST, MOST))
    if not len(long):
        return ends.tolist(), firm
    out, done = [], 0
    for i in long.tolist():
        out += ends[done:i].tolist()
        out += _split(text[starts[i] : ends[i]], int(starts[i]))
        done = i + 1
    return out + ends[done:].tolist(), firm


def _leaves(text: bytes, start: int, ends: list[int]) -> list[tuple[bytes, int]]:
    """The hashes of paragraphs and their bytes."""
    leaves = []
    for end in ends:
        leaves.append((blake2b(text[start:end], digest_size=LEAF, person=b"paragraph").digest(), end - start))
        start = end
    return leaves


def _sections(leaves: list[tuple[bytes, int]]) -> list[list[tuple[bytes, int]]]:
    sections, start = [], 0
    for i, (leaf, _) in enumerate(leaves, 1):
        if leaf[0] % SECTION == 0 or i - start == SECTION_MOST:
            sections.append(leaves[start:i])
            start = i
    return [*sections, leaves[start:]] if start < len(leaves) else sections


class Tree:
    """The Merkle tree of a text: sections (hash, [(leaf, bytes)]) under a root that hashes theirs and the whole text's."""

    def __init__(self, text: bytes, like: Tree | None = None):
        """like: the tree of a text that starts alike, if there is one; what both have is not hashed again."""
        kept, at = [], 0
        if like is not None:
            same = _common(text, like.text)
            if i := int(np.searchsorted(like.firm, same, "right")):
                at = int(like.firm[i - 1])
                kept = like.leaves[: bisect_right(like.ends, at)]
        ends, firm = _ends(text, at)
        self.text = text
        self.ends = [*like.ends[: len(kept)], *ends] if kept else ends
        self.firm = np.concatenate([like.firm[:i], firm]) if kept else firm
        self.leaves = kept + _leaves(text, at, ends)
        self.sections = []
        for own in _sections(self.leaves):
            self.sections.append((blake2b(b"".join([leaf for leaf, _ in own]), digest_size=BRANCH, person=b"section").hexdigest(), own))
        whole = sha256(text).digest()
        self.root = blake2b(b"".join([whole, *(bytes.fromhex(h) for h, _ in self.sections)]), digest_size=ROOT, person=b"root").hexdigest()

    def encode(self) -> str:
        """The fingerprint: root, then per section its hash and its leaves with their sizes, as hex with marks between."""
        return ":".join([self.root, *(h + "".join([f"-{leaf.hex()}{n:x}" for leaf, n in own]) for h, own in self.sections)])


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two texts have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0])


def fingerprint(text: str | None) -> str:
    return Tree((text or "").encode("utf-8", "surrogatepass")).encode()


def decode(fp: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    """Root, and per section its hash and its (leaf, bytes)."""
    root, *sections = fp.split(":")
    width = 2 * LEAF
    out = []
    for s in sections:
        branch, *leaves = s.split("-")
        out.append((branch, [(x[:width], int(x[width:], 16)) for x in leaves]))
    return root, out


def _alike(a: str, left: list[tuple[str, list]], b: str, right: list[tuple[str, list]]) -> float:
    if a == b:
        return 1.0
    total = sum(n for side in (left, right) for _, leaves in side for _, n in leaves)
    weight = {branch: sum(n for _, n in leaves) for side in (left, right) for branch, leaves in side}
    same = Counter(s for s, _ in left) & Counter(s for s, _ in right)
    common = sum(weight[s] * n for s, n in same.items())

    def rest(side: list[tuple[str, list]]) -> Counter:
        gone, found = Counter(same), Counter()
        for branch, leaves in side:
            if gone[branch]:
                gone[branch] -= 1
            else:
                found.update(leaves)
        return found

    common += sum(n * times for (_, n), times in (rest(left) & rest(right)).items())
    return min(2 * common / total, 1 - 1e-9) if total else 0.0


def likeness(a: str, b: str) -> float:
    """1 for equal roots; else twice the bytes of common leaves over the bytes of both, below 1. Two fingerprints alone decide it.

    Equal sections are set off whole; only leaves of the others are compared.
    """
    return _alike(*decode(a), *decode(b))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the text of a, merged, that no branch of b has in the same order: where it was edited.

    Sections are matched first, then the leaves of those sections that differ.
    """
    import difflib

    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    (_, left), (_, right) = decode(a), decode(b)
    found: list[tuple[int, int]] = []
    sizes = [sum(n for _, n in leaves) for _, leaves in left]
    starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    for tag, i, j, k, m in difflib.SequenceMatcher(None, [s for s, _ in left], [s for s, _ in right], autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        own = [x for _, leaves in left[i:j] for x in leaves]
        other = [x for _, leaves in right[k:m] for x in leaves]
        at = np.concatenate(([0], np.cumsum([n for _, n in own]))).astype(int) + starts[i]
        for kind, p, q, _, _ in difflib.SequenceMatcher(None, own, other, autojunk=False).get_opcodes():
            if kind != "equal":
                found.append((int(at[p]), int(at[q])))
    merged: list[tuple[int, int]] = []
    for x, y in found:
        if merged and merged[-1][1] >= x:
            merged[-1] = (merged[-1][0], y)
        else:
            merged.append((x, y))
    return merged


def edited(text: str, after: str) -> str:
    """text with its last quarter of code points replaced by the first as many of after, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text; null is empty."""
    made = F.pandas_udf(lambda texts: pd.Series([fingerprint(t) for t in texts]), "string")
    return docs.select("doc_id", made(F.col("text").cast("string")).alias("fingerprint"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, and within a part of id: each with what its text becomes by the row after it. One text and its
    successor are held at a time, and results up to some bytes."""
    held: tuple[int, int | None, str, Tree] | None = None
    columns: list[list] = [[] for _ in range(7)]
    size = 0

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        for c in columns:
            c.clear()
        return made

    for batch in batches:
        for i in range(batch.num_rows):
            part, doc_id, text = (batch.column(c)[i].as_py() for c in range(3))
            text = text or ""
            tree = Tree(text.encode("utf-8", "surrogatepass"))
            if held is not None and held[0] == part:
                _, own_id, before, own = held
                now = edited(before, text).encode("utf-8", "surrogatepass")
                changed = Tree(now, own) if now != own.text else own
                fp = own.encode()
                changed_fp = changed.encode() if changed is not own else fp
                values = (own_id, len(before), sha256(now).hexdigest(), fp, changed_fp, _alike(own.root, own.sections, changed.root, changed.sections), _alike(own.root, own.sections, tree.root, tree.sections))
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
                size += len(fp) + len(changed_fp)
                if size > MOST_HELD:
                    yield out()
                    size = 0
            held = (part, doc_id, text, tree)
    yield out()


def compare_successors(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last quarter taken from the next document.

    docs: doc_id, text; other columns are ignored. Documents follow each other by doc_id, null last, ties by text, and
    after the last comes the first. Null text is empty. A single document follows itself; an empty table gives no rows.
    Every text is shuffled once: rows go to parts of an id range, and the first row of each part goes to the one before
    too, where it ends the row of pairs. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part, parts = id_parts(rows, "doc_id", ROWS_PER_TASK)
    dealt = rows.withColumn("part", part)
    # The first row of each part that has any, and the part before it; the first of all ends the last part.
    ids = rows.select("doc_id").withColumn("part", part)
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    seconds = {r["part"]: (firsts[i - 1]["part"], r["first"]) for i, r in enumerate(firsts)}
    if not seconds:
        return rows.limit(0).mapInArrow(_compared, _KINDS)
    heads = docs.sparkSession.createDataFrame([(part, first, before) for part, (before, first) in seconds.items()], "h_part int, h_first long, before int")
    # Where rows share a part's first id, the first of them by text is meant; others of them are few.
    least = dealt.join(F.broadcast(heads), (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("h_first")))
    least = least.groupBy(F.col("before").alias("part")).agg(F.min_by(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.coalesce("text", F.lit(""))).alias("row"))
    tails = least.select("row.doc_id", "row.text", "part", F.lit(True).alias("tail"))
    whole = dealt.select("doc_id", "text", "part", F.lit(False).alias("tail")).unionByName(tails)
    # Null texts are empty ones: which of them is first among ties is all the same.
    order = ["part", "tail", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    keys = F.element_at(F.array(*[F.lit(k) for k in keys_of_partitions(parts)]), F.col("part") + 1) if parts <= 4_096 else F.col("part")
    sorted_rows = whole.repartition(parts, keys).sortWithinPartitions(*order)
    return sorted_rows.select("part", "doc_id", "text").mapInArrow(_compared, _KINDS)


_KINDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_successors(spark.read.parquet(f"{sf_dir}/documents.parquet"))
