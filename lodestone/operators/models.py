"""Where a model attaches: an iterator function that loads it once a task, with errors kept by row.

The networks themselves are not part of this repository; any callable that maps a
batch of inputs to outputs can be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applied(load: Callable[[], Callable[[list], list]], value: Column, kind: str = "string") -> Column:
    """struct(value, error) of a batch model; a batch that fails is run row by row, so only bad rows carry an error."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(x):
            try:
                return model([x])[0], None
            except Exception as e:  # the row's own failure is data here
                return None, f"{type(e).__name__}: {e}"

        for s in batches:
            try:
                rows = [(y, None) for y in model(s.tolist())]
            except Exception:
                rows = [one(x) for x in s]
            yield pd.DataFrame(rows, columns=["value", "error"])

    return F.pandas_udf(run, f"struct<value: {kind}, error: string>")(value)


def split_errors(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a value, and rows with an error; together they are all rows."""
    bad = F.col(f"{result}.error").isNotNull()
    return df.where(~bad), df.where(bad)
