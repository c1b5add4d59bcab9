"""SimHash near-duplicates: exact links at a few differing bits, through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import written
from quirework.operators.graph import components

BITS = 64
#: The bands of a fingerprint: at 3 differing bits two fingerprints agree on one of four.
BANDS = 4
#: Fingerprints that one index holds.
BLOCK = 4096
#: Children of a node of the index.
FAN = 16
#: Shingles hashed before their votes are added up, so a long text takes no more memory than a short one.
CHUNK = 65_536

#: A-Z to a-z; the bytes of other characters stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
CLEAN = bytes(SPACES[LOWER[b]] for b in range(256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text over its shingles of width words, as an unsigned number; 0 where there is no word."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(CLEAN).split(b" ") if w]
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    starts, stops = (starts[: len(words) - width + 1], stops[width - 1 :]) if len(words) >= width else (starts[:1], stops[-1:])
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        a, b = starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist()
        h = np.fromiter((digest(line[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order, in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over codes in Gray order. A node holds the bits that all codes below it share and its parent's don't
    (mask, pattern); a search adds up differences from the root down and leaves a node as soon as they pass the limit."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, []
        ones, zeros = codes, ~codes
        while len(ones) > 1 or not self.levels:
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            self.levels.append((ones | zeros, ones))
        self.levels.reverse()

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code), as places, that differ in at most so many bits; where all codes of a node do, its first alone."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        above, so_far, whole = np.zeros(len(queries), np.uint64), np.zeros(len(queries), np.int64), []
        for depth, (mask, ones) in enumerate(self.levels):
            fresh = mask[node] & ~above
            so_far = so_far + np.bitwise_count((queries[q] ^ ones[node]) & fresh)
            left = np.bitwise_count(~mask)[node]
            span = FAN ** (len(self.levels) - depth)
            all_in = so_far + left <= most
            whole.append((q[all_in], node[all_in] * span))
            go = (so_far <= most) & ~all_in
            q, node, so_far = q[go], node[go], so_far[go]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.codes)
            counts = np.minimum(FAN, below - node * FAN)
            children = np.repeat(node * FAN - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            above, q, so_far, node = np.repeat(mask[node], counts), np.repeat(q, counts), np.repeat(so_far, counts), children
        near = so_far + np.bitwise_count((queries[q] ^ self.codes[node]) & ~above) <= most
        return np.concatenate([a for a, _ in whole] + [q[near]]), np.concatenate([b for _, b in whole] + [node[near]])

    def alike(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Links within nodes whose codes can't differ in more bits than most: each code to the node's first."""
        mask, n = self.levels[-1][0], len(self.codes)
        first = np.arange(n) // FAN
        tight = np.bitwise_count(~mask)[first] <= most
        return np.flatnonzero(tight), (first * FAN)[tight]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places one label, the smallest, by pointer jumping."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, low, high = a[differ], b[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(label, high, low)
        while (jumped := label[label] != label).any():
            label[jumped] = label[label[jumped]]


def links(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what codes (in Gray order) at most so many bits apart connect, as few as that takes."""
    label, index = np.arange(len(codes)), GrayIndex(codes)
    _merge(label, *index.alike(most))
    for at in range(0, len(codes), 512):
        q, c = index.search(codes[at : at + 512], most)
        _merge(label, q + at, c)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in batch.column(0):
                a, b = links(np.frombuffer(codes.as_py(), np.uint64), most)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def bands(agreed: int) -> list[int]:
    """The bits that a group does not agree on yet, cut into bands of about equal width, as masks."""
    free = [bit for bit in range(BITS) if not agreed >> bit & 1]
    cuts = [len(free) * i // BANDS for i in range(BANDS + 1)]
    return [sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups (the bits that they agree on, their fingerprints) to rows: each fingerprint once for each band of the other
    bits, with the bits that it agrees on there, what they are, and its place in the Gray order."""
    for batch in batches:
        for agreed, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = np.frombuffer(raw.as_py(), np.uint64)
            now = [(agreed % (1 << BITS)) | mask for mask in bands(agreed % (1 << BITS))]
            masks = np.repeat(np.array(now, np.uint64), len(codes))
            all_codes = np.tile(codes, len(now))
            columns = (masks, all_codes & masks, all_codes, gray_rank(all_codes) ^ np.uint64(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["agreed", "value", "fp", "rank"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to groups that agree on nothing yet."""
    for batch in batches:
        codes = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([codes.tobytes()])], ["agreed", "codes"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of agreed, value and Gray rank to blocks of one group; a large group makes several."""
    held: list[np.ndarray] = []
    key: tuple[int, int] | None = None

    def block(codes: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, len(codes), codes.tobytes()), kinds, strict=True)], ["agreed", "value", "n", "codes"])

    for batch in batches:
        agreed, value, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((np.diff(agreed) != 0) | (np.diff(value) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            if a == b:
                continue
            if key != (now := (int(agreed[a]), int(value[a]))):
                if held:
                    yield block(np.concatenate(held))
                held, key = [], now
            own = codes[a:b].view(np.uint64)
            # A fingerprint can come to a group on two ways; equal ones follow each other.
            fresh = np.concatenate(([not held or held[-1][-1] != own[0]], own[1:] != own[:-1]))
            held.append(own[fresh]) if fresh.any() else None
            while sum(map(len, held)) > BLOCK:
                whole = np.concatenate(held)
                yield block(whole[:BLOCK])
                held = [whole[BLOCK:]]
    if held:
        yield block(np.concatenate(held))


def fingerprint_links(codes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect exactly what fingerprints at most so many bits apart (3 at the most) connect.

    codes: fp, distinct. Every two such fingerprints agree on one of four bands of their bits. Fingerprints are dealt
    to groups of one band's value each and sorted by Gray rank over all partitions; a group that fits a block is
    searched through its index. A group that does not is never compared block by block: on the bits that it does not
    agree on yet, two such fingerprints again agree on one of four bands, so its members are dealt anew by those, and
    so on. At 1e11 fingerprints a group of 16 agreed bits has 1.5 million members, one of 28 bits 400. A group's free
    bits shrink by a quarter a round, and so few are left in the end that it must fit: no task sees more than a block.
    Of the links of a block, only as many come out as connect it: no group of near copies is written out as pairs.
    """
    if not 0 <= most < BANDS:
        raise ValueError(f"most must be from 0 to {BANDS - 1}")
    found, free = None, BITS
    groups = codes.select("fp").mapInArrow(_packed, "agreed long, codes binary")
    while True:
        free -= free // BANDS
        dealt = groups.mapInArrow(_dealt, "agreed long, value long, fp long, rank long")
        # A group may lie in several partitions, and then is dealt anew; the last ones, which fit a block, may not.
        order = ["agreed", "value", "rank"] if 1 << free > BLOCK else ["agreed", "value"]
        rows = dealt.repartitionByRange(*order).sortWithinPartitions("agreed", "value", "rank").select("agreed", "value", "fp")
        blocks = written(rows.mapInArrow(_blocks, "agreed long, value long, n int, codes binary"), "simhash-blocks")
        several = blocks.groupBy("agreed", "value").count().filter("count > 1").select(F.col("agreed").alias("s_agreed"), F.col("value").alias("s_value"))
        several = written(several, "simhash-several")
        done = several.isEmpty()
        large = (F.col("agreed") == F.col("s_agreed")) & (F.col("value") == F.col("s_value"))
        whole = blocks if done else blocks.join(several, large, "left_anti")
        own = written(whole.filter("n > 1").select("codes").mapInArrow(_links(most), "a long, b long"), "simhash-links")
        found = own if found is None else found.unionByName(own)
        if done:
            return found
        groups = blocks.join(several, large, "left_semi").select("agreed", "codes")


def _classes(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document; (node_fp, root, component_id) of every fingerprint."""
    seen = written(fingerprints(docs), "simhash-fps")
    nodes = written(seen.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = written(fingerprint_links(nodes.select("fp"), most), "simhash-links")
    roots = components(found)
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "simhash-roots")
    named = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"), "simhash-names")
    return seen, written(nodes.join(named, nodes["root"] == F.col("r")).select(F.col("fp").alias("node_fp"), "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, most: int = 3) -> DataFrame:
    """The class of each document among those that SimHash links connect.

    docs: doc_id, text; other columns are ignored. Texts of equal fingerprint are one node from the start, so copies,
    however many, are never paired. Null and empty texts have fingerprint 0 and link like any other. A class is named by
    its smallest doc_id, null where it has none but null; rows that repeat a doc_id come out as often. An empty table
    gives no rows. Returns doc_id, fp (signed), component_id.
    """
    seen, classes = _classes(docs, most)
    return seen.join(classes, seen["fp"] == classes["node_fp"]).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """docs without near duplicates: of each class the document with the smallest doc_id stays.

    Where other rows repeat that id, and where a class has null ids alone, the first of its rows by text stays. Texts
    go through one shuffle, by doc_id and unsorted, whatever their number: the ids that stay can't be broadcast.
    """
    seen, classes = _classes(docs, most)
    named = written(seen.join(classes, seen["fp"] == classes["node_fp"]).select("doc_id", "component_id"), "simhash-found")
    ids = named.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("least"))
    ids = written(ids.filter("least"), "simhash-kept")
    once = ids.filter("rows = 1 and kept_id is not null").select("kept_id").hint("shuffle_hash")
    kept = docs.join(once, docs["doc_id"] == F.col("kept_id"), "left_semi")
    repeated = ids.filter("rows > 1 or kept_id is null").select("kept_id")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")
    again = written(again.select(F.struct(*[again[c] for c in docs.columns]).alias("row"), again["text"].alias("text")), "simhash-again")
    again = again.select("row", F.pandas_udf(_fingerprint_of, "long")("text").alias("fp"))
    again = again.join(classes, F.col("fp") == F.col("node_fp")).filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    first = again.groupBy("root").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), "row.text")).alias("row"))
    return kept.unionByName(first.select("row.*"))
