"""Folds over each key's rows in order, with a state that is carried along: what comes next depends on all before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def folded(rows: DataFrame, key: str, order: list[Column | str], fresh: Callable[[], object], step: Callable, last: Callable | None, schema: str) -> DataFrame:
    """Rows of step(state, row) -> (state, tuple or None), and of last(key, state, rows seen) -> tuple when a key ends, as schema has them.

    Keys are dealt to tasks and sorted there; a task holds one state and one batch, however many rows a key has. A key
    is folded by one task, as its order demands.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[object, object, int] | None = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = getattr(row, key)
                if held is None or held[0] != own:
                    if held is not None and last is not None:
                        out.append(last(*held))
                    held = (own, fresh(), 0)
                state, made = step(held[1], row)
                held = (own, state, held[2] + 1)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=columns)
        if held is not None and last is not None:
            yield pd.DataFrame([last(*held)], columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
