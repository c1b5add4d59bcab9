"""Statements that change keyed tables, as the table that is there after them: upserts, compare and set, replaced children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.storage import written


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with each one's place (from 1) in an order over all of them.

    Ranges of the order are sorted, each in its own task; a table with a row a range says how many rows come before it.
    Rows that the order doesn't tell apart are placed at random, but once.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "placed")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = sizes.select("_part", before.alias("_before"))
    # A row a partition.
    return ranged.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, (F.col("_before") + inside + 1).cast("long")).drop("_at", "_part", "_before")


def latest_instant(*instants: Column) -> Column:
    """The latest of ISO-8601 texts by milliseconds, nulls left out; of equal ones the first."""
    millis = lambda c: F.unix_millis(F.to_timestamp(c))
    best = instants[0]
    for c in instants[1:]:
        best = F.when(best.isNull() | (millis(c) > millis(best)), F.coalesce(c, best)).otherwise(best)
    return best


def upsert(table: DataFrame, changes: DataFrame, key: str, sets: tuple[str, ...], order: str, counter: str | None = None) -> DataFrame:
    """table after changes (its columns) were inserted one after the other, by order, each replacing the columns of sets where its key is there.

    A new key has the other columns of its first change. counter, if given, counts a row's changes. Keys that are null
    are new each time in SQL and are left out here. Changes are aggregated by key before they meet the table.
    """
    rest = [c for c in table.columns if c not in (key, *sets, counter)]
    given = changes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    given = given.agg(F.max_by(F.struct(*sets), order).alias("_last"), F.min_by(F.struct(F.lit(0).alias("_"), *rest), order).alias("_first"), F.count("*").alias("_n"))
    both = table.join(given, table[key] == F.col("_key"), "full_outer")
    new, touched = table[key].isNull() & F.col("_key").isNotNull(), F.col("_key").isNotNull()
    out = {key: F.coalesce(table[key], F.col("_key"))}
    out |= {c: F.when(touched, F.col("_last")[c]).otherwise(table[c]) for c in sets}
    out |= {c: F.when(new, F.col("_first")[c]).otherwise(table[c]) for c in rest}
    if counter:
        out[counter] = F.coalesce(table[counter], F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))
    return both.select(*[out[c].cast(dict(table.dtypes)[c]).alias(c) for c in table.columns])


def insert_or_ignore(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """table with those of rows whose key it has not, one of each key; null keys count as unequal to any."""
    known = table.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    fresh = rows.dropDuplicates(list(key)).join(known, same, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def compare_and_set(table: DataFrame, changes: DataFrame, key: str, version: str, sets: tuple[str, ...], live: Column | None = None) -> DataFrame:
    """table after changes (key, expected, columns of sets) with the outcome of each key's row: kept, updated, inserted or conflict.

    A change is made where the row's version is the expected one and live holds; its version is one more then. A change
    that expects nothing inserts a row that is not there, as version 1. Of several changes of a key, the least by
    (expected, sets) is tried alone: after it, the others expect a version that is gone.
    """
    given = changes.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col("expected").isNotNull(), "expected", *sets)).alias("_c"))
    both = table.join(given, table[key] == F.col("_key"), "full_outer")
    there, asked = table[key].isNotNull(), F.col("_key").isNotNull()
    fits = F.coalesce(there & (table[version] == F.col("_c.expected")) & (F.lit(True) if live is None else live), F.lit(False))
    fresh = ~there & asked & F.col("_c.expected").isNull()
    outcome = F.when(~asked, "kept").when(fits, "updated").when(fresh, "inserted").otherwise("conflict")
    out = {key: F.coalesce(table[key], F.col("_key")), version: F.when(fits, table[version] + 1).when(fresh, 1).otherwise(table[version])}
    out |= {c: F.when(fits | fresh, F.col("_c")[c]).otherwise(table[c]) for c in sets}
    columns = [out.get(c, table[c]).cast(dict(table.dtypes)[c]).alias(c) for c in table.columns]
    return both.select(*columns, outcome.alias("outcome"))


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """children after those of parents (column parent) were deleted and fresh ones inserted."""
    gone = parents.select(F.col(parent).alias("_gone")).distinct()
    return children.join(gone, F.col(parent) == F.col("_gone"), "left_anti").unionByName(fresh.select(children.columns))


def delete_where_in(table: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """table without rows whose column is among keys."""
    return table.join(keys.select(F.col(key).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")
