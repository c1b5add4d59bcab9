"""Mixing sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import WORD, written

#: Rows of one source in a range of keys, about: ranges are cut finer as the input grows.
ROWS_PER_RANGE = 20_000


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """Each source's target from (source, source_size), a row a source.

    Weights repeat over the sources in code-point order, null last. The targets sum to share of all sizes as far as
    none passes most_epochs of its source: with the sources in order of cap over weight, the capped ones come first,
    and what they leave is shared by weight among the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = (
        s.withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_after", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", (F.col("wanted") - F.col("capped_before")) / F.col("weight_after"))
    )
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """A row a source: its target, whole epochs, and the key, id and fraction at which the last epoch is cut."""
    rows = sized.count()
    digits = max(0, math.ceil(math.log(max(1, rows / ROWS_PER_RANGE), 16)))
    sized = sized.withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    ranges = written(ranges, "mix-ranges")
    sources = targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, share, most_epochs)
    budget = F.floor("target")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = written(sources.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix-sources")
    cut, depth = sources.filter("rest > 0").select(F.col("source").alias("c_source"), F.lit("").alias("c_range"), F.lit(0).cast("long").alias("before"), "rest"), 0
    while depth < digits:
        cut, depth = _descend(ranges.withColumnRenamed("in_range", "n"), cut, depth, min(depth + 2, digits)), min(depth + 2, digits)
    # Only the ranges that a budget ends in are sorted; rows of one id are summed before.
    few = _small(sources)
    inside = sized.withColumnRenamed("size", "n").join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("range") == F.col("c_range")))
    inside = written(inside.groupBy("source", "key", "doc_id").agg(F.sum("n").alias("n")).withColumn("range", F.col("key")), "mix-inside")
    cut = _descend(inside, cut, depth, depth + 2)
    inside = inside.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("c_source")) & F.col("key").startswith(F.col("c_range"))).withColumnRenamed("n", "size")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", upto).filter((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    inside = inside.select(F.col("source").alias("c_source"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("upto") + F.col("size")).alias("cut_rest"), F.col("size").alias("cut_size"))
    joined = sources.join(inside, sources["source"].eqNullSafe(inside["c_source"]), "left").drop("c_source", "rest")
    return written(joined, "mix-plan")


def _descend(rows: DataFrame, cut: DataFrame, depth: int, to: int) -> DataFrame:
    """cut (c_source, c_range, before, rest: where a source's budget ends, in a range of keys told by depth digits) with ranges of `to` digits.

    rows: source, range, n. A source's rows are summed by the digits that are new, so a window sorts 256 sums of a source, however many rows it has.
    """
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.substring("range", 1, depth) == F.col("c_range")) if depth else F.col("source").eqNullSafe(F.col("c_source")))
    sums = inside.groupBy("source", F.substring("range", 1, to).alias("part"), "before", "rest").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    ends = ends.select(F.col("source").alias("c_source"), F.col("part").alias("c_range"), (F.col("upto") - F.col("n")).alias("before"), "rest")
    return written(ends, "mix-cut")


def _small(sources: DataFrame) -> bool:
    """Whether a table with a row a source may be broadcast: at most 10,000 rows."""
    return sources.limit(10_001).count() <= 10_000


def _apply(sized: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "p_source")
    out = sized.join(F.broadcast(plan) if _small(plan) else plan, sized["source"].eqNullSafe(F.col("p_source")))
    is_cut = (F.col("key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    # Where no key is marked, the budget ends with an epoch and nothing of another is taken.
    last = F.when(F.col("cut_key").isNull(), 0).when(is_cut, F.floor(F.col("size") * F.col("cut_rest") / F.col("cut_size"))).when((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("cut_id")))), F.col("size")).otherwise(0)
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long")).drop("p_source")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _key(F.col("doc_id"), seed).alias("key"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """How many words of each document a mix takes.

    docs: doc_id, text, source; other columns are ignored. Keys are hashes of seed and doc_id; within each source the
    documents follow in key order, distributed prefix sums over key ranges, coarse ones first, find where the source's
    budget ends, and the document there is taken in part. Budgets past a source's size take whole epochs first.

    Null text counts 0 words, null source is a source of its own and the last, rows of one doc_id stand together and
    share what is left at the cut in proportion. An empty table gives no rows. Returns doc_id, source, size,
    source_size, target, taken.
    """
    sized = written(_sized(docs, seed), "mix-sized")
    return _apply(sized, _plan(sized, weights, share, most_epochs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: each document as often as its epochs say, the last copy cut after its share of words.

    The columns are those of docs; n_chars, where there is one, follows the text. Other than mix_plan, texts flow
    through no shuffle: the plan has a row a source.
    """
    sized = written(_sized(docs, seed), "mix-sized")
    plan = _plan(sized, weights, share, most_epochs)
    kept = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    rows = kept.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("key", _key(F.col("doc_id"), seed))
    rows = _apply(rows, plan).filter(F.col("taken") > 0)
    copies = F.expr("transform(sequence(0L, cast(ceil(taken / size) as bigint) - 1L), i -> least(size, taken - i * size))")
    rows = rows.select("whole", "text", "size", F.explode(copies).alias("words"))
    cut = F.when(F.col("words") >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), 1, F.col("words").cast("int")), ""))
    rows = rows.withColumn("cut", cut)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight
  FROM sized GROUP BY source),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER w - cap))
            / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM ratios
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
reached AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level < ratio),
goals AS (
  SELECT l.source, l.source_size, CASE WHEN r.level IS NULL THEN l.cap ELSE least(l.cap, l.weight * r.level) END AS target
  FROM levels l, reached r),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
running AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM sized)
SELECT r.doc_id, r.size, b.source_size, b.target,
       CAST(b.epochs * r.size + greatest(0, least(r.size,
            floor(b.target) - b.epochs * b.source_size - (r.upto - r.size))) AS BIGINT) AS taken
FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""
