"""What the operators of this package share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.storage import discard, remove, shared_dir, temporary, written

__all__ = ["WORD", "discard", "held_out", "id_parts", "keys_of_partitions", "remove", "shared_dir", "temporary", "written"]

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) leaves 2 when divided by 4; nothing is learned from them. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Parts that an id range is cut into at most; parts beyond that grow, and their sorts spill.
MOST_PARTS = 20_000


def id_parts(rows: DataFrame, name: str, rows_per_part: int) -> tuple[Column, int]:
    """The part of each row, by ranges of the id in the named column with about as many rows each, and how many parts there are.

    Null ids stand in the last part. Rows of one id are in one part.
    """
    parts = min(MOST_PARTS, max(1, -(-rows.count() // rows_per_part)))
    splits: list[int] = []
    if parts > 1:
        splits = sorted(set(rows.select(F.percentile_approx(name, [i / parts for i in range(1, parts)], 10 * parts).alias("p")).first()["p"] or []))
    if not splits:
        return F.lit(0), 1

    def place(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(splits, np.int64), ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), len(splits), at), dtype="int32")

    return F.pandas_udf(place, "int")(F.col(name)), len(splits) + 1


def keys_of_partitions(parts: int) -> list[int]:
    """For each of so many shuffle partitions the least key (int, not negative) that hash partitioning deals to it.

    Parts numbered from 0 on that are dealt by their numbers fall together by chance; by these keys each gets a task.
    """
    found: dict[int, int] = {}
    start = 0
    while len(found) < parts:
        # Murmur3 of an int with seed 42, as the engine partitions by.
        keys = np.arange(start, start + 16 * parts, dtype=np.uint32)
        turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
        h = np.uint32(42) ^ (turned(keys * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        at, first = np.unique(h.view(np.int32).astype(np.int64) % parts, return_index=True)
        for k, i in zip(at.tolist(), first.tolist(), strict=True):
            found.setdefault(k, start + i)
        start += len(keys)
    return [found[k] for k in range(parts)]
