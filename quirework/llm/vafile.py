"""Exact top-k by inner product through vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import discard, keys_of_partitions, written

#: Vectors in a block of candidates (65,536 at most), and in a block of queries.
BLOCK, QUERY_BLOCK = 4_096, 1_024
#: Candidates that a task holds the approximations of, at most.
SPAN = 2_097_152
#: Cells that each component is cut into: a cell's number is a byte.
CELLS = 256
#: Candidates of a block whose bounds give the first threshold.
FIRST = 1_024
#: Exact vectors that a search reads at once, in the order of their bounds.
STEP = 64
#: Candidates held for a block of queries before a task gives them away.
MOST_HELD = 4_000_000
#: Pairs of a query and a candidate that a task scans, while there are no more than so many tasks.
PAIRS, MOST_TASKS = 50_000_000_000, 256

_LONG = 2**63 - 1


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in 16 bits each where all fit, else as they are."""
    small = numbers.size and np.abs(numbers).max() < 2**15
    return numbers.astype("<i2" if small else "<f8").tobytes()


def _unpacked(raw: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * rows * columns else "<f8").reshape(rows, columns)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of one key starts and ends; none for no keys."""
    edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
    return zip(edges[:-1], edges[1:], strict=True)


# Approximations.


def approximated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells: a byte a component, low, high: the least and greatest value in each cell of each component).

    A component with few values has a cell for each, and its approximation is exact; others have cells of about as many
    values each, so a value far off widens no cell but its own.
    """
    n, dim = vectors.shape
    cells, low, high = np.empty((n, dim), np.uint8), np.zeros((dim, CELLS)), np.zeros((dim, CELLS))
    for d in range(dim):
        own = vectors[:, d]
        values = np.unique(own)
        if len(values) <= CELLS:
            cells[:, d] = np.searchsorted(values, own)
            low[d, : len(values)] = high[d, : len(values)] = values
            continue
        cuts = np.quantile(own, np.linspace(0, 1, CELLS + 1)[1:-1], method="lower")
        cells[:, d] = np.searchsorted(cuts, own, "right")
        least, most = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
        np.minimum.at(least, cells[:, d], own)
        np.maximum.at(most, cells[:, d], own)
        low[d], high[d] = np.where(np.isinf(least), 0, least), np.where(np.isinf(most), 0, most)
    return cells, low, high


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query with each vector, from the vector's cells alone; one array where both are the same."""
    with np.errstate(all="ignore"):
        # The greatest a sum of products can be: below these, floating numbers hold it and its parts exactly.
        reach = float((np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(1, keepdims=True)).max(initial=0.0))
        kind = np.float32 if reach < 2**22 else np.float64
        at = cells.T.astype(np.intp)
        middle = np.take_along_axis(((low + high) / 2).astype(kind), at, 1)
        scores = queries.astype(kind) @ middle
        loose = 0.0 if reach < 2**50 else reach * queries.shape[1] * 1e-15
        if not loose and not (high > low).any():
            return scores, scores
        spread = np.abs(queries).astype(kind) @ np.take_along_axis(((high - low) / 2).astype(kind), at, 1) + kind(loose)
        return np.nan_to_num(scores - spread, nan=-np.inf), np.nan_to_num(scores + spread, nan=np.inf)


def _told(scores: np.ndarray) -> np.ndarray:
    """Bounds of scores as they come out: those beyond a long are all alike."""
    return scores if scores.dtype == np.float32 else np.clip(scores, np.nextafter(-(2.0**63), 0), 2.0**63)


_KINDS = {"q": np.int32, "least": np.float64, "most": np.float64, "first": np.int64, "block": np.int64, "place": np.int32}


class Found:
    """Of a block of queries: the candidates that may be among the best, and what another must reach to be one."""

    def __init__(self, queries: int, k: int):
        # One more than k, as the query's own row is among the candidates.
        self.wanted = k + 1
        #: The least score and the least id of the last of the wanted so far: who has less, or as much and a greater id, is out.
        self.threshold, self.id = np.full(queries, -np.inf), np.full(queries, _LONG)
        self.near = {name: np.empty(0, kind) for name, kind in _KINDS.items()}
        self.fresh: list[dict[str, np.ndarray]] = []
        self.held = self.count = 0

    def add(self, **found: np.ndarray) -> None:
        """Candidates by query, bounds of the score, least id, block and place."""
        at = self.threshold[found["q"]]
        stays = (found["most"] > at) | ((found["most"] == at) & (found["first"] <= self.id[found["q"]]))
        self.fresh.append({name: found[name][stays].astype(kind) for name, kind in _KINDS.items()})
        self.count += len(self.fresh[-1]["q"])
        if self.count > max(self.held, self.wanted * len(self.threshold)) // 2:
            self.thin()

    def thin(self) -> None:
        """Leave out what the wanted best of each query pass for certain."""
        near = {name: np.concatenate([self.near[name], *(f[name] for f in self.fresh)]) for name in _KINDS}
        order = np.lexsort((near["first"], -near["least"], near["q"]))
        q = near["q"][order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        last = starts + self.wanted - 1
        last = order[last[last < np.append(starts[1:], len(q))]]
        # Candidates that were given away set thresholds that those left may not reach.
        higher = last[(near["least"][last] > (at := self.threshold[near["q"][last]])) | ((near["least"][last] == at) & (near["first"][last] < self.id[near["q"][last]]))]
        self.threshold[near["q"][higher]], self.id[near["q"][higher]] = near["least"][higher], near["first"][higher]
        at = self.threshold[near["q"]]
        stays = (near["most"] > at) | ((near["most"] == at) & (near["first"] <= self.id[near["q"]]))
        self.near, self.fresh = {name: c[stays] for name, c in near.items()}, []
        self.held, self.count = len(self.near["q"]), 0

    def given(self) -> dict[str, np.ndarray]:
        """The candidates so far, which are no longer held; what must be reached stays."""
        self.thin()
        near, self.near, self.held = self.near, {name: c[:0] for name, c in self.near.items()}, 0
        return near

    def scan(self, queries: np.ndarray, block: int, firsts: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The candidates of a block whose greatest score reaches the threshold."""
        with np.errstate(all="ignore"):
            # What no vector of the block can pass, whatever its cells.
            most = _told(np.maximum(queries, 0) @ high.max(1) + np.minimum(queries, 0) @ low.min(1))
        if (most < self.threshold).all():
            return
        least, most = (_told(scores) for scores in bounds(queries, cells, low, high))
        first = least[:, :FIRST]
        sure = self.threshold
        if np.isinf(sure).any() and first.shape[1] >= self.wanted:
            sure = np.maximum(sure, np.partition(first, first.shape[1] - self.wanted, 1)[:, -self.wanted])
        # Numbers of the scores' own kind: where these are float32 they are whole and small.
        q, place = np.divmod(np.flatnonzero(most >= sure.astype(most.dtype)[:, None]), most.shape[1])
        self.add(q=q, least=least[q, place], most=most[q, place], first=firsts[place], block=np.full(len(q), block), place=place)


def _batch(names: str, values: list) -> pa.RecordBatch:
    """One row of the columns that are named with their kinds."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[c[1]]) for v, c in zip(values, columns, strict=True)], [c[0] for c in columns])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            yield {name: c[i].as_py() for name, c in columns.items()}


_MEET = "task int, kind int, number long, dim int, n int, width int, vectors binary, low binary, high binary, firsts binary"
_NEAR = "q_block long, n_q int, " + ", ".join(f"{name} binary" for name in _KINDS)


def _scan(k: int):
    """Rows of _MEET, for each task its approximations (kind 0) before its queries: to the candidates of each block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for r in _rows(batches):
            if r["task"] != task:
                task, held = r["task"], []
            if r["kind"] == 0:
                low = _unpacked(r["low"], r["dim"], r["width"])
                high = _unpacked(r["high"], r["dim"], r["width"]) if r["high"] else low
                held.append((r["number"], np.frombuffer(r["firsts"], np.int64), np.frombuffer(r["vectors"], np.uint8).reshape(r["n"], r["dim"]), low, high))
                continue
            queries, found = _unpacked(r["vectors"], r["n"], r["dim"]).astype(np.float64), Found(r["n"], k)
            for number, firsts, cells, low, high in held:
                found.scan(queries, number, firsts, cells, low.astype(np.float64), high.astype(np.float64))
                if found.held + found.count > MOST_HELD:
                    found.thin()
                    if found.held > MOST_HELD // 2:
                        yield _batch(_NEAR, [r["number"], r["n"], *(c.tobytes() for c in found.given().values())])
            yield _batch(_NEAR, [r["number"], r["n"], *(c.tobytes() for c in found.given().values())])

    return run


_LEFT = "block long, q_block long, q binary, place binary, most binary"


def _joined(k: int):
    """Rows of _NEAR, in the order of query blocks, to the candidates that are left when all are known: a row a block of exact vectors to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Found] | None = None

        def out(q_block: int, found: Found) -> Iterator[pa.RecordBatch]:
            near = found.given()
            order = np.argsort(near["block"], kind="stable")
            for a, b in _runs(near["block"][order]):
                own = order[a:b]
                yield _batch(_LEFT, [int(near["block"][own[0]]), q_block, *(near[c][own].tobytes() for c in ("q", "place", "most"))])

        for r in _rows(batches):
            if held is None or held[0] != r["q_block"]:
                if held:
                    yield from out(*held)
                held = (r["q_block"], Found(r["n_q"], k))
            held[1].add(**{name: np.frombuffer(r[name], kind) for name, kind in _KINDS.items()})
        if held:
            yield from out(*held)

    return run


# Exact vectors.


def exact(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Inner products of whole numbers, exactly."""
    with np.errstate(all="ignore"):
        reach = np.abs(vectors).max(initial=0.0) * np.abs(query).sum()
    if reach < 2**53:
        return (vectors @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query.tolist()]
    return [sum(a * int(b) for a, b in zip(whole, v, strict=True)) for v in vectors.tolist()]


def _best(query: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], most: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of candidates, their scores as longs, read in the order of their bounds until the rest can't reach the kth; a row of own is left out."""
    order, scores, at = np.argsort(-most, kind="stable"), [], 0
    while at < len(order):
        if at > k and sorted(scores, reverse=True)[k] > most[order[at]]:
            break
        scores += [max(-_LONG, min(_LONG, score)) for score in exact(query, vectors[order[at : at + STEP]])]
        at += STEP
    rows, gone = [], False
    for i, score in zip(order, scores, strict=False):
        found = ids[i].tolist()
        if not gone and own in found and (vectors[i] == query).all():
            found.remove(own)
            gone = True
        rows += [(score, x) for x in found]
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]


_READ = "block long, kind int, q_block long, dim int, n int, vectors binary, ids binary, counts binary, q binary, place binary, most binary"
_PICKED = "q_block long, kind int, dim int, n int, vectors binary, ids binary, counts binary, q binary, place binary, most binary"


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _READ, each block's exact vectors (kind 0) before what is asked of it: to the vectors that are asked, once a block of queries."""
    for r in _rows(batches):
        if r["kind"] == 0:
            dim, vectors = r["dim"], _unpacked(r["vectors"], r["n"], r["dim"])
            flat, counts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int32)
            ends = np.cumsum(counts)
            continue
        own, place = np.unique(np.frombuffer(r["place"], np.int32), return_inverse=True)
        ids = np.concatenate([flat[ends[p] - counts[p] : ends[p]] for p in own])
        yield _batch(_PICKED, [r["q_block"], 1, dim, len(own), _packed(vectors[own]), ids.tobytes(), counts[own].tobytes(), r["q"], place.astype(np.int32).tobytes(), r["most"]])


def _ranked(k: int):
    """Rows of _PICKED, each block's queries (kind 0) before the vectors picked for it: to the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, picked = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not picked:
                return
            queries, q_ids = _unpacked(asked["vectors"], asked["n"], asked["dim"]), np.frombuffer(asked["ids"], np.int64)
            vectors = np.concatenate([_unpacked(r["vectors"], r["n"], r["dim"]) for r in picked])
            flat = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in picked])
            counts = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in picked])
            ends = np.cumsum(counts)
            q, most = (np.concatenate([np.frombuffer(r[c], t) for r in picked]) for c, t in (("q", np.int32), ("most", np.float64)))
            before = np.cumsum([0, *(r["n"] for r in picked)])
            place = np.concatenate([np.frombuffer(r["place"], np.int32) + b for r, b in zip(picked, before, strict=False)])
            order, rows = np.argsort(q, kind="stable"), []
            for a, b in _runs(q[order]):
                mine = order[a:b]
                at, own = int(q[mine[0]]), place[mine]
                ids = [flat[ends[p] - counts[p] : ends[p]] for p in own]
                best = _best(queries[at].astype(np.float64), vectors[own].astype(np.float64), ids, most[mine], int(q_ids[at]), k)
                rows += [(int(q_ids[at]), rank, vec_id, score) for rank, (score, vec_id) in enumerate(best, 1)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for r in _rows(batches):
            if r["kind"] == 0:
                yield from out()
                asked, picked = r, []
            else:
                picked.append(r)
        yield from out()

    return run


# Blocks.

_CANDIDATES = "block long, dim int, n int, width int, cells binary, low binary, high binary, firsts binary, vectors binary, ids binary, counts binary"
_QUERIES = "q_block long, dim int, n int, vectors binary, ids binary"


def _blocks(size: int, approximate: bool):
    """Rows (ids, v) to blocks of one dimension. A block's number is from its place: no two blocks have the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[list[int]], list[list[float]]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal count
            ids, rows = held.pop(dim)
            count += 1
            vectors = np.array(rows, np.float64)
            flat = np.array([x for own in ids for x in own], np.int64).tobytes()
            values = [(part << 32) + count, dim, len(ids)]
            if approximate:
                cells, low, high = approximated(vectors)
                # The limits of the cells that have vectors, once where each has one value.
                width = int(cells.max()) + 1
                low, high = low[:, :width], high[:, :width]
                firsts = np.array([own[0] for own in ids], np.int64).tobytes()
                values += [width, cells.tobytes(), _packed(low), b"" if (low == high).all() else _packed(high), firsts, _packed(vectors), flat, np.array([len(own) for own in ids], np.int32).tobytes()]
            else:
                values += [_packed(vectors), flat]
            return _batch(_CANDIDATES if approximate else _QUERIES, values)

        for batch in batches:
            for own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(own)
                rows.append(v)
                if len(ids) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def _dealt(n: int, blocks: int, n_q: int, q_blocks: int, tasks: int) -> tuple[int, int]:
    """Spans of candidates and groups of query blocks. A group more costs each candidate's cells once more, a span more costs each query and its best."""
    tasks = max(tasks, min(MOST_TASKS, n * n_q // PAIRS))
    spans = max(-(-n // SPAN), min(blocks, round((2.5 * tasks) ** 0.5)))
    return spans, min(q_blocks, -(-tasks // spans))


def top_k(vectors: DataFrame, k: int = 20, step: int = 20, scale: float = 64.0) -> DataFrame:
    """The k rows of highest inner product for each row whose vec_id is divisible by step, exactly.

    vectors: vec_id, embedding; other columns are ignored. A component x counts as floor(scale * x). Candidates of a
    query are all rows of its dimension but its own row; rows that repeat a vec_id are rows of their own. Ties go to the
    smaller vec_id. Vectors that are null or empty, or hold a null or non-finite component (also after scaling), take no
    part, nor do rows without vec_id. Sums are exact whatever their size; scores that a long can't hold come out as the
    nearest long (2**63 - 1 or its negative) and rank as such. An empty table gives no rows.

    Equal vectors are one candidate with their k + 1 least ids, so a vector that many rows hold costs no more than
    another. Candidates are written once as blocks: a byte a component, the limits of its cell, and apart from them the
    exact vectors. A task holds the approximations of a span of candidates and scans them for one block of queries after
    another: what is dealt out are spans and blocks of queries, not their pairs. It gives the candidates that may be
    among the best k + 1, by bounds and least ids; when the spans are put together, the kth least score is a bound over
    the whole table. Exact vectors are picked for the candidates that reach it, and read in the order of their bounds
    until the kth score is certain: about k a query come out, whatever the number of blocks. Work grows with the square
    of the table's rows; what is written and shuffled grows with the rows.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    scaled = lambda x: x.cast("double") * scale
    floor = lambda y: F.when(F.rint(y) > y, F.rint(y) - 1.0).otherwise(F.rint(y)) + 0.0
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(scaled(x)) | (F.abs(scaled(x)) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = F.transform("embedding", lambda x: floor(scaled(x))).alias("v")

    equal = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(equal)).filter(F.col("place") <= k + 1)
    classes = least.withColumn("ids", F.collect_list("vec_id").over(equal.rowsBetween(0, k))).filter("place = 1")
    blocks = written(classes.select("ids", v).mapInArrow(_blocks(BLOCK, True), _CANDIDATES), "va-blocks")
    asked = rows.filter(F.col("vec_id") % step == 0)
    asked = asked.select(F.array("vec_id").alias("ids"), v).repartition(max(1, -(-asked.count() // QUERY_BLOCK)))
    queries = written(asked.mapInArrow(_blocks(QUERY_BLOCK, False), _QUERIES), "va-queries")

    # Spans of candidates and groups of query blocks meet each other: a task each.
    sizes = {r["dim"]: (r["n"], r["blocks"]) for r in blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()}
    wanted = {r["dim"]: (r["n"], r["blocks"]) for r in queries.groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()}
    meets = [(dim, span, part) for dim in wanted for spans, parts in [_dealt(*sizes[dim], *wanted[dim], 4 * spark.sparkContext.defaultParallelism)] for span in range(spans) for part in range(parts)]
    if not meets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = min(len(meets), 20_000)
    keys = keys_of_partitions(tasks)
    whole = spark.createDataFrame([(*m, i, keys[i % tasks]) for i, m in enumerate(meets)], "m_dim int, m_span int, m_part int, task int, key int")
    counts = whole.groupBy("m_dim").agg((F.max("m_span") + 1).alias("spans"), (F.max("m_part") + 1).alias("parts"))

    def dealt(table: DataFrame, number: str, count: str, place: str) -> DataFrame:
        own = table.join(F.broadcast(counts.withColumnRenamed("m_dim", "c_dim")), F.col("dim") == F.col("c_dim")).withColumn("own", F.pmod(F.xxhash64(number), count))
        return own.join(F.broadcast(whole), (F.col("dim") == F.col("m_dim")) & (F.col("own") == F.col(place)))

    none = F.lit(None).cast("binary")
    cells = dealt(blocks, "block", "spans", "m_span").select("key", "task", F.lit(0).alias("kind"), F.col("block").alias("number"), "dim", "n", "width", F.col("cells").alias("vectors"), "low", "high", "firsts")
    own = dealt(queries, "q_block", "parts", "m_part").select("key", "task", F.lit(1).alias("kind"), F.col("q_block").alias("number"), "dim", "n", F.lit(0).alias("width"), "vectors", none.alias("low"), none.alias("high"), none.alias("firsts"))
    meet = cells.unionByName(own).repartition(tasks, "key").sortWithinPartitions("task", "kind")
    near = meet.drop("key").mapInArrow(_scan(k), _NEAR)

    left = near.repartition("q_block").sortWithinPartitions("q_block").mapInArrow(_joined(k), _LEFT)
    left = written(left, "va-candidates")
    columns = [c.split()[0] for c in _READ.split(", ")]
    held = blocks.select("block", "dim", "n", "vectors", "ids", "counts").withColumn("kind", F.lit(0)).unionByName(left.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    picked = held.select(columns).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_pick, _PICKED)
    columns = [c.split()[0] for c in _PICKED.split(", ")]
    found = queries.withColumn("kind", F.lit(0)).unionByName(picked, allowMissingColumns=True).select(columns)
    found = found.repartition("q_block").sortWithinPartitions("q_block", "kind")
    out = written(found.mapInArrow(_ranked(k), "query_id long, rank int, vec_id long, score long"), "va-found")
    for table in (blocks, queries, left):
        discard(table)
    return out


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER () AS row_no
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.row_no, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON c.row_no <> q.row_no AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id, row_no ORDER BY score DESC, vec_id) <= 20
"""
