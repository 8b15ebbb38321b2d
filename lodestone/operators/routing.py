"""Requests that go to one of two models by their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import models


def route(duration: Column, longest: float) -> Column:
    """``chunk`` for recordings over ``longest`` seconds, ``whole`` for others and those of unknown length."""
    return F.when(duration > longest, "chunk").otherwise("whole")


def transcribed(rows: DataFrame, duration: Column, longest: float, value: Column, whole: Callable, chunked: Callable, kind: str) -> DataFrame:
    """Rows with ``route``, ``result`` and ``error``.

    Each route's model sees its own rows in batches; rows that a model fails on carry the
    error, so that the others keep their results. Rows stay as they are, each with its keys.
    """
    sent = rows.withColumn("route", route(duration, longest))
    parts = [
        sent.where(F.col("route") == name).withColumn("r", models.applied(make, value, kind)) for name, make in (("whole", whole), ("chunk", chunked))
    ]
    return parts[0].unionByName(parts[1]).select(*sent.columns, F.col("r.value").alias("result"), F.col("r.error").alias("error"))
