"""Running sums within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], path: str) -> DataFrame:
    """Adds, by name, the sums of columns over a key's rows up to and with each, by ``order`` (unique in a key).

    Rows are dealt to sorted ranges, which are written to ``path``; sums are made
    within a range and those of the key's ranges before are added. So a key that a
    third of all rows share is spread like any other; a key's ranges are few.
    """
    named = rows.withColumns(sums)
    named.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    spread = rows.sparkSession.read.parquet(path)
    earlier = Window.partitionBy(*(f"__{k}" for k in keys)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    of_range = spread.groupBy(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__at")).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    bases = of_range.select(*(f"__{k}" for k in keys), "__at", *(F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}") for s in sums))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumns({s: F.sum(s).over(inside) for s in sums})
    same = F.col("__range") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = spread.join(bases, same)
    return out.select(*rows.columns, *((F.col(s) + F.col(f"__{s}")).alias(s) for s in sums))


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], path: str, name: str = "k") -> DataFrame:
    """Adds a number from 0 within keys by ``order``, however many rows a key has."""
    out = running_totals(rows, keys, order, {name: F.lit(1).cast("long")}, path)
    return out.withColumn(name, F.col(name) - 1)
