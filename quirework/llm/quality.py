"""Quality scores by compression: how much better a dictionary of good text than one of bad text shortens a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import discard, held_out, written

#: Bytes compressed at once. A text is as many blocks as it takes, so that a long one can't be its own dictionary.
BLOCK = 1_024
#: Bytes of a dictionary, and the level of compression.
DICTIONARY, LEVEL = 65_536, 3


@dataclass
class Compressors:
    """Two dictionaries, and the calibration that turns a normalised difference of sizes into a score: knots of a rising
    curve, and a logistic curve whose small share keeps scores apart where the knots are level."""

    good: bytes
    bad: bytes
    knots: tuple[list[float], list[float]] = ((0.0,), (0.5,))
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self) -> None:
        self._ready: list[zstandard.ZstdCompressor] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": []}

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good), as the sizes of the whole text compressed block by block with either dictionary; 0 for no text."""
        if not self._ready:
            for data in (self.good, self.bad):
                # Too few samples to train on are a dictionary as they are.
                own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO) if data else None
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        good = bad = 0
        a, b = (c.compress for c in self._ready)
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            good += len(a(part))
            bad += len(b(part))
        return (bad - good) / (bad + good) if text else 0.0

    def scores(self, differences: np.ndarray) -> np.ndarray:
        logistic = 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -30, 30)))
        return 0.97 * np.interp(differences, *self.knots) + 0.03 * logistic


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or what there is of samples where they don't suffice to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def rising(differences: np.ndarray, labels: np.ndarray, weights: np.ndarray, bins: int = 60) -> tuple[list[float], list[float]]:
    """Knots of the share of label 1 as it rises with the difference: bins of equal weight, joined where they would fall."""
    order = np.argsort(differences, kind="stable")
    d, y, w = differences[order], labels[order], weights[order]
    bin_of = np.minimum((np.cumsum(w) / w.sum() * bins).astype(int), bins - 1)
    blocks: list[list[float]] = []
    for k in np.unique(bin_of):
        own = bin_of == k
        blocks.append([(d[own] * w[own]).sum(), (y[own] * w[own]).sum(), w[own].sum()])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [x / n for x, _, n in blocks], [min(max(p / n, 0.001), 0.999) for _, p, n in blocks]


def calibrate(differences: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, held back a little so that it ends on separable rows."""
    x = np.stack([differences, np.ones(len(differences))], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-6]) * max(1.0, weights.sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + ridge @ w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _measured(model: Compressors, scored: bool):
    """key and the difference of each text, or its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.difference((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(found) if scored else found, pa.float64())], ["key", "value"])

    return run


def labelled_texts(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Each labelled text once, without the text itself: quality, id (the least doc_id that has it), h (its hash) and n (its code points).

    Rows that are held out or have no text, and ids whose labels contradict each other, give none; a text that documents
    of either label have counts once for each. A narrow row a document is all that is shuffled, however long the texts
    and however often they are copied.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    marked = marked.select(F.col("doc_id").cast("long").alias("marked_id"), F.col("quality").cast("int").alias("quality"))
    own = docs.filter(~held_out(F.col("doc_id")) & (F.length("text") > 0))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), F.col("text").cast("string")).alias("h"), F.length("text").alias("n"))
    return own.join(marked, F.col("doc_id") == F.col("marked_id")).groupBy("quality", "h").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, blocks: int = 6_000, rows: int = 6_000, seed: int = 11) -> Compressors | None:
    """Dictionaries and calibration from labelled rows that are not held out.

    docs: doc_id, text; labels: doc_id, quality (0 or 1). About blocks blocks of either label's texts, taken by hash
    from anywhere in them, make the dictionaries; about rows whole texts of either label, none of which gave a block,
    the calibration, weighed back to the labels' shares. A text counts once, however many documents copy it. What is
    drawn is decided over a narrow table of hashes and lengths; a second reading of the documents then takes the drawn
    texts alone, by a join with at most about 2 * (blocks + rows) ids, which are broadcast. None where a label is missing.
    """
    share = lambda *c: F.pmod(F.xxhash64(F.lit(seed + 1), *c), F.lit(1_000_003)) / 1_000_003.0
    texts = labelled_texts(docs, labels, seed).withColumn("drawn", share("h")).withColumn("teaches", F.col("drawn") < 0.5)
    texts = written(texts, "quality-texts")
    sizes = texts.groupBy("quality", "teaches").agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("n") / BLOCK)).alias("blocks")).collect()
    size = {(r["quality"], r["teaches"]): (r["n"], r["blocks"]) for r in sizes}
    if len(size) < 4:
        discard(texts)
        return None
    by_quality = lambda what: F.when(F.col("quality") == 1, what(1)).otherwise(what(0))
    chance = by_quality(lambda q: min(1.0, blocks / size[q, True][1]))
    numbers = F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))
    taught = texts.filter("teaches").withColumn("at", F.filter(numbers, lambda i: share(F.col("h"), i) < chance)).filter(F.size("at") > 0)
    tried = texts.filter(~F.col("teaches") & (F.col("drawn") < by_quality(lambda q: 0.5 + min(0.5, 0.5 * rows / size[q, False][0])))).withColumn("at", F.lit(None).cast("array<int>"))
    drawn = written(taught.unionByName(tried).select("quality", "h", "id", "at"), "quality-drawn")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))
    whole = whole.filter(F.xxhash64(F.lit(seed), "text") == F.col("h"))
    cut = F.transform("at", lambda i: F.substring("text", i * BLOCK + 1, F.lit(BLOCK)))
    sampled = sorted((r["quality"], r["block"]) for r in whole.filter("at is not null").select("quality", F.explode(cut).alias("block")).distinct().collect())
    of = lambda q: dictionary([b.encode()[:BLOCK] for k, b in sampled if k == q])
    model = Compressors(of(1), of(0))
    key = F.struct("quality", "h")
    found = whole.filter("at is null").select(key, "text").mapInArrow(_measured(model, False), "key struct<quality:int,h:long>, value double").distinct().collect()
    discard(drawn)
    discard(texts)
    if not found:
        return None
    d, y = np.array([r["value"] for r in found], np.float64), np.array([r["key"]["quality"] for r in found], np.float64)
    each = {q: size[q, False][0] / max(1, (y == q).sum()) for q in (0, 1)}
    weights = np.where(y == 1, each[1], each[0])
    order = np.lexsort((y, d))
    d, y, weights = d[order], y[order], weights[order]
    model.knots = rising(d, y, weights)
    model.slope, model.offset = calibrate(d, y, weights)
    return model


def quality_scores(docs: DataFrame, model: Compressors | None) -> DataFrame:
    """The score of each whole text.

    docs: doc_id, text; other columns are ignored. Null and empty texts show no difference and get what the calibration
    says of that; without a model every score is 0.5. Rows that repeat come out as often; an empty table gives no rows.
    Returns doc_id, score (0 to 1).
    """
    model = model or Compressors(b"", b"")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measured(model, True), "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = quality_scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
