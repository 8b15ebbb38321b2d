"""Group-wise numpy functions over sorted partitions.

``applyInPandas`` costs milliseconds a group; with very many small groups that
is nearly all of the time. Here a partition's rows are sorted by group and
handed over in large batches, and a group costs only its own arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_group(df: DataFrame, keys: list[str], order: list[str], make: Callable[[dict], dict], schema: str) -> DataFrame:
    """``make`` maps a group's columns to result columns of equal length.

    Columns come as numpy arrays (lists for nested types and strings), sorted by
    ``order``, which should be unique in a group. A group must fit a task.
    """
    kinds = StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kinds), kinds.names
    spread = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        import pyarrow as pa

        kept: dict | None = None

        def result(columns: dict, ends: list[int]):
            out: dict[str, list] = {n: [] for n in names}
            start = 0
            for end in ends:
                for n, v in make({c: x[start:end] for c, x in columns.items()}).items():
                    out[n].extend(v.tolist() if isinstance(v, np.ndarray) else v)
                start = end
            return pa.RecordBatch.from_pydict(out, schema=arrow)

        for b in batches:
            columns = {}
            for f, c in zip(b.schema, b.columns, strict=True):
                plain = pa.types.is_primitive(f.type) and c.null_count == 0
                columns[f.name] = c.to_numpy(zero_copy_only=False) if plain else c.to_pylist()
            if kept is not None:
                columns = {c: [*kept[c], *x] if isinstance(x, list) or isinstance(kept[c], list) else np.concatenate([kept[c], x]) for c, x in columns.items()}
            n = len(columns[keys[0]])
            if not n:
                continue
            new = np.zeros(n - 1, bool)
            for k in keys:
                v = columns[k]
                new |= (v[1:] != v[:-1]) if isinstance(v, np.ndarray) else np.array([x != y for x, y in zip(v[1:], v, strict=False)], bool)
            ends = (np.flatnonzero(new) + 1).tolist()
            if ends:
                yield result({c: x[: ends[-1]] for c, x in columns.items()}, ends)
                columns = {c: x[ends[-1] :] for c, x in columns.items()}
            kept = columns
        if kept is not None:
            yield result(kept, [len(kept[keys[0]])])

    return spread.mapInArrow(run, schema)
