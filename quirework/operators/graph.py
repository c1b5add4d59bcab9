"""Connected components by contraction, each round a few joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node and root for each node of edges (a, b: long); nodes have one root if and only if edges connect them.

    In a round each node points at the neighbour whose hash, salted by the round, is least, if it is below its own; the
    edges are then rewritten from pointer to pointer, loops and repeats dropped. Random orders shrink any graph by a
    constant factor a round, chains included, and a star goes in two. Neighbours are never gathered, only their
    minimum, which tasks take before they shuffle. The pointers of all rounds are then followed backwards from the last.
    Every table of a round is written, so lost executors cost no earlier round, and skewed joins read plain tables.
    """
    rounds = []
    now = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    while not now.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = now.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("next")))
        least = both.groupBy("node").agg(F.min(order("next")).alias("m"))
        points = written(least.select("node", F.least("m", order("node"))["n"].alias("to")), "cc-points")
        rounds.append(points)
        of_a, of_b = points.toDF("na", "pa"), points.toDF("nb", "pb")
        moved = now.join(of_a, F.col("a") == F.col("na")).select("pa", "b").join(of_b, F.col("b") == F.col("nb")).filter("pa != pb")
        fresh = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        discard(now)
        now = fresh
    discard(now)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).filter("false")
    roots = rounds[-1].toDF("node", "root")
    for points in reversed(rounds[:-1]):
        later = roots.toDF("n", "r")
        found = points.join(later, F.col("to") == F.col("n"), "left").select("node", F.coalesce("r", "to").alias("root"))
        roots = written(found, "cc-roots")
    return roots
