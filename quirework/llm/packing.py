"""Packing documents into sequences of bounded length by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import written

#: Rows whose ranks one task counts, about, for each length.
ROWS_PER_BUCKET = 20_000
#: Characters tokenized at once; longer texts are cut where no token can reach across.
CHUNK = 1_000_000
#: Steps without a filling that count as a node of the search.
STEPS = 10_000

#: Between two letters and a lone space the pre-tokenizer always cuts before the space.
_CUT = re.compile(r"(?<=[a-z])(?= [a-z])")
#: What both tokenizer libraries split alike: no control or unusual blank, no script beyond the Latin ones.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")


@lru_cache(maxsize=4)
def _tokenizer(name: str) -> Callable[[str], np.ndarray]:
    """ids of a text by the vocabulary file; plain texts go through the faster library, which has the same ids for them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(name))
    fast, special = None, [t.content for t in slow.get_added_tokens_decoder().values()]
    if name == "byte_bpe_50k.json":
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK)
            part, at = (text[at:], len(text)) if cut is None else (text[at : cut.start()], cut.start())
            plain = fast is not None and _PLAIN.fullmatch(part)
            out.append(np.array(fast.encode_ordinary(part) if plain else slow.encode(part, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    return ids


def pieces_of(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    first = n % room or room
    return [(0, min(first, n)), *((at, room) for at in range(first, n, room))]


def _cut(tokenizer: str, end: int, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _tokenizer(tokenizer)
        for batch in batches:
            doc, piece, start, length, crc, raw = [], [], [], [], [], []
            for d, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (at, n) in enumerate(pieces_of(len(ids), room)):
                    own = ids[at : at + n].tobytes()
                    for column, value in zip((doc, piece, start, length, crc, raw), (d.as_py(), k, at, n, zlib.crc32(own), own if with_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((doc, piece, start, length, crc, raw), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def best_fit(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over lengths and their counts: (lengths in a bin, such bins)."""
    open_bins: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (fits := min((r for r in open_bins if r >= length), default=None)) is not None:
            filling, n = next(iter(open_bins[fits].items()))
            used = min(left, n)
            left -= used
            open_bins[fits][filling] -= used
            if not open_bins[fits][filling]:
                del open_bins[fits][filling]
            if not open_bins[fits]:
                del open_bins[fits]
            open_bins.setdefault(fits - length, Counter())[*filling, length] += used
        each = room // length
        for copies, n in ((each, left // each), (left % each, 1)):
            if copies and n:
                open_bins.setdefault(room - copies * length, Counter())[(length,) * copies] += n
    return [(filling, n) for bins in open_bins.values() for filling, n in bins.items()]


def least_bins(counts: dict[int, int], room: int) -> int:
    """A lower bound of the bins: by total length, and with the lengths above each half split point counted apart."""
    lengths = sorted(counts)
    most = -(-sum(k * n for k, n in counts.items()) // room)
    for small in {0, *(k for k in lengths if k <= room // 2)}:
        alone = sum(n for k, n in counts.items() if k > room - small)
        half = {k: n for k, n in counts.items() if room / 2 < k <= room - small}
        rest = sum(k * n for k, n in counts.items() if small <= k <= room / 2)
        free = room * sum(half.values()) - sum(k * n for k, n in half.items())
        most = max(most, alone + sum(half.values()) + max(0, -(-(rest - free) // room)))
    return most


def fillings(counts: dict[int, int], space: int, waste: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of a space that leave at most so much waste, by waste, then by many of large lengths.

    A filling is left out where one of its lengths could give way to a larger one that is there and fits, or where one
    more fits: the larger filling dominates it. A table of subset sums leads past sums that no lengths make. None is
    given for every STEPS steps without a filling, so that a search can count them.
    """
    lengths = sorted((k for k, n in counts.items() if n and k <= space), reverse=True)
    every = _sums(lengths, counts, space)
    for w in range(min(waste, space) + 1):
        goal = space - w
        # Of these there are always some left: fillings that leave room for one, or for one in a smaller length's place, are dominated.
        plenty = sorted(k for k in lengths if counts[k] * k > goal)
        if plenty and plenty[0] <= w:
            return
        if not every[0] >> goal & 1:
            continue
        sums, inside = every, lengths
        if w and plenty:
            inside = [k for k in lengths if (i := bisect_right(plenty, k)) == len(plenty) or plenty[i] > k + w]
            sums = _sums(inside, counts, space)
            if not sums[0] >> goal & 1:
                continue
        # The next length's place, what is to be made, what is chosen.
        steps, stack = 0, [(0, goal, ())]
        while stack:
            at, left, chosen = stack.pop()
            steps += 1
            if steps % STEPS == 0:
                yield None
            if not left:
                if not w or not _dominated(lengths, counts, chosen, w):
                    steps = 0
                    yield chosen
                continue
            k = inside[at]
            for n in range(min(counts[k], left // k) + 1):
                if sums[at + 1] >> (left - n * k) & 1:
                    stack.append((at + 1, left - n * k, (*chosen, *(k,) * n)))


def _sums(lengths: list[int], counts: dict[int, int], space: int) -> list[int]:
    """Bit s of entry i: the lengths from the i-th on can make s, which is at most space."""
    out, full = [1], (1 << (space + 1)) - 1
    for k in reversed(lengths):
        own, n, step = out[-1], min(counts[k], space // k), 1
        while n:
            take = min(step, n)
            own |= own << k * take & full
            n, step = n - take, step * 2
        out.append(own)
    return out[::-1]


def _dominated(lengths: list[int], counts: dict[int, int], filling: tuple[int, ...], waste: int) -> bool:
    free = [x for x in lengths if counts[x] > filling.count(x)]
    return any(x <= waste or any(k < x <= k + waste for k in set(filling)) for x in free)


def complete_bins(counts: dict[int, int], room: int, nodes: int = 2_000) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many bins have each: best-fit decreasing, bettered by branch and bound over completions.

    A branch completes bins around the largest length left, with as many bins of one filling at once as the counts
    allow; it ends where the waste so far leaves no way to beat the incumbent. Every undominated filling is a branch,
    the tightest first. The search ends at the lower bound or after so many nodes, with the incumbent; STEPS steps
    without a filling count as a node.
    """
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, room)
    bound, total = least_bins(counts, room), sum(k * n for k, n in counts.items())
    used = sum(n for _, n in best)
    spent = 0

    def branch(left: dict[int, int], done: tuple, n_done: int, wasted: int) -> tuple:
        largest = max(left)
        rest = {**left, largest: left[largest] - 1}
        return fillings(rest, room - largest, (used - 1) * room - total - wasted), left, done, n_done, wasted

    # Each entry of the stack: the fillings to come, what is left, the bins so far, their number and waste.
    stack = [branch(counts, (), 0, 0)] if used > bound else []
    while stack and used > bound and spent < nodes:
        options, left, done, n_done, wasted = stack[-1]
        allowed, largest = (used - 1) * room - total - wasted, max(left)
        filling = next(options, False)
        if filling is False or filling is not None and room - largest - sum(filling) > allowed:
            stack.pop()
            continue
        spent += 1
        if filling is None:
            continue
        whole = Counter((largest, *filling))
        times = min(left[k] // c for k, c in whole.items())
        waste = room - largest - sum(filling)
        if times * waste > allowed:
            times = 1
        after = {k: n for k, n in ((k, n - times * whole[k]) for k, n in left.items()) if n}
        done = (*done, ((largest, *filling), times))
        finished = best_fit(after, room)
        if (n := n_done + times + sum(m for _, m in finished)) < used:
            best, used = [*done, *finished], n
        if after:
            stack.append(branch(after, done, n_done + times, wasted + times * waste))
    return best


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (length, first rank), first sequence, offset."""
    runs, taken, sequence = [], Counter(), 0
    for filling, n in plan:
        offset = 0
        for length in filling:
            runs.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    runs.sort()
    return tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else tuple(np.empty((4, 0), np.int64))


def _placed(slots: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = slots
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted((length << 50) + first, (n << 50) + rank, "right") - 1
            columns = [*batch.columns[:5], *batch.columns[6:], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, room: int = 1024, tokenizer: str = "byte_bpe_50k.json", end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of at most room tokens as can be found, a row a piece.

    docs: doc_id, text; other columns are ignored. A document is its text's ids and then the id end; only one that is
    longer than room is cut, into full pieces after a first that may be shorter. The driver solves the packing for the
    histogram of lengths, which has at most room rows whatever the input, as fillings and how often each is used; a
    piece finds its place by its rank among the pieces of its length, counted in buckets, so that no task holds all
    pieces of one length. Gaps are at the end of sequences alone.

    Null text is empty: a piece of one token. Rows that repeat a doc_id are packed each. An empty table gives no rows.
    Returns doc_id, piece, start, length, ids_crc32, ids (binary, little-endian uint32; null unless with_ids),
    sequence_id, offset.
    """
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer, end, room, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    cut = written(cut, "pack-pieces")
    plan = complete_bins({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}, room)
    buckets = max(1, cut.count() // ROWS_PER_BUCKET)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sums = sums.select(F.col("length").alias("s_length"), F.col("bucket").alias("s_bucket"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("inside", inside).join(sums, (F.col("length") == F.col("s_length")) & (F.col("bucket") == F.col("s_bucket")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).cast("long").alias("rank"), "ids")
    return ranked.mapInArrow(_placed(_slots(plan)), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack(..., with_ids=True): sequence_id, ids (binary), n_tokens."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return own.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), "n_tokens")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
