"""Rows of a corpus: dedup, hash splits, plans with resume, set algebra, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import strings as S
from lodestone.operators.running import numbered


def drop_empty(df: DataFrame, *texts: str) -> DataFrame:
    """Texts stripped; rows with an empty one are left out."""
    out = df.withColumns({t: S.strip(F.coalesce(t, F.lit(""))) for t in texts})
    for t in texts:
        out = out.where(F.col(t) != "")
    return out


def digest(*values: Column) -> Column:
    """SHA-256 of values, each with its length before it, so that no two lists of values look alike."""
    part = lambda v: F.coalesce(F.concat_ws(":", F.length(v.cast("string")), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(part(v)) for v in values)), 256)


def first_occurrence(df: DataFrame, key: list[Column | str], order: list[Column | str], keep: list[str] | None = None) -> DataFrame:
    """The first row of each key by ``order``, which must be unique; of the columns ``keep``, if given.

    ``min_by`` of the whole row combines before the shuffle, so a key that a
    third of all rows share reaches its task as one row for each task before. Keys
    are their digests: a long text is moved once, in its row.
    """
    column = lambda c: c if isinstance(c, Column) else F.col(c)
    rank = F.struct(*map(column, order))
    row = F.struct(*(F.col(f"`{c}`") for c in keep or df.columns))
    kept = df.groupBy(digest(*map(column, key)).alias("__key")).agg(F.min_by(row, rank).alias("__row"))
    return kept.select("__row.*")


def with_hash_split(df: DataFrame, stem: Column, train: int = 80, validation: int = 10) -> DataFrame:
    bucket = S.md5_bucket(stem)
    split = F.when(bucket < train, "train").when(bucket < train + validation, "val").otherwise("test")
    return df.withColumn("split", split)


def with_policy_split(df: DataFrame, policy: Column, native: Column, held_val: Column, held_test: Column, stem: Column) -> DataFrame:
    """``native`` keeps a row's own split, ``holdout`` names rows of val and test, ``hash`` deals by stem."""
    bucket = S.md5_bucket(stem)
    dealt = F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")
    held = F.when(held_test, "test").when(held_val, "val").otherwise("train")
    return df.withColumn("split", F.when(policy == "native", native).when(policy == "holdout", held).otherwise(dealt))


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both; a split's val and test sets must share none."""
    return a.select(key).intersect(b.select(key))


def straddling(df: DataFrame, stem: Column, split: str = "split") -> DataFrame:
    """Prefixes before the first ``_`` that occur in several splits."""
    prefix = F.split_part(stem, F.lit("_"), F.lit(1))
    return df.groupBy(prefix.alias("prefix")).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def shard(df: DataFrame, row: str, shards: int, own: int) -> DataFrame:
    return df.where(F.pmod(F.col(row), F.lit(shards)) == own)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def output_plan(df: DataFrame, row: str, base: Column, text: str, existing: DataFrame | None = None) -> DataFrame:
    """Target of each row; one whose base path another text last claimed gets ``__<row>``.

    A row claims the path that it gets, so a suffixed row leaves the base path
    to its former owner: the owner is always the first text that claimed it.
    """
    out = df.withColumn("base", base)
    owner = out.groupBy("base").agg(F.min_by(text, row).alias("owner"))
    out = out.join(owner, "base")
    stem = F.regexp_replace("base", r"\.wav$", "")
    taken = F.col("owner") != F.col(text)
    out = out.withColumn("target", F.when(taken, F.concat(stem, F.lit("__"), F.col(row).cast("string"), F.lit(".wav"))).otherwise(F.col("base")))
    if existing is None:
        return out.withColumn("skip", F.lit(False)).drop("base", "owner")
    there = existing.select(F.col("path").alias("target"), F.lit(True).alias("skip")).distinct()
    return out.join(there, "target", "left").withColumn("skip", F.coalesce("skip", F.lit(False))).drop("base", "owner")


def with_results(plan: DataFrame, results: DataFrame, key: str, value: str, missing: str) -> DataFrame:
    """Plan with results; rows without one carry the error ``missing``."""
    out = plan.join(results.withColumn("__there", F.lit(True)), key, "left")
    return out.withColumn("error", F.when(F.col("__there").isNull(), missing)).drop("__there")


def zipped(a: DataFrame, a_order: list[Column | str], b: DataFrame, b_order: list[Column | str], path: str) -> DataFrame:
    """Rows of two tables side by side by their places (``position``) in their orders; raises in the query if the lengths differ."""
    left = numbered(a, [], a_order, f"{path}/a", "position").withColumn("__a", F.lit(1))
    right = numbered(b, [], b_order, f"{path}/b", "position").withColumn("__b", F.lit(1))
    both = left.join(right, "position", "full")
    uneven = F.col("__a").isNull() | F.col("__b").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("the sides differ in length"))).otherwise(F.col("position"))
    return both.withColumn("position", checked).drop("__a", "__b")


def contiguous_shards(df: DataFrame, order: list[Column | str], rows: int, path: str, most: int | None = None) -> DataFrame:
    """Adds ``shard``: runs of ``rows`` rows in order, of the first ``most`` rows if that is given."""
    ranked = numbered(df, [], order, path, "__k")
    if most is not None:
        ranked = ranked.where(F.col("__k") < most)
    return ranked.withColumn("shard", F.floor(F.col("__k") / rows)).drop("__k")


def known_or_raise(df: DataFrame, value: str, known: DataFrame, key: str) -> DataFrame:
    """Lookup join by name; an unknown name raises."""
    out = df.join(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known, F.col(value) == F.col(key), "left")
    bad = F.concat(F.lit("unknown name: "), F.coalesce(F.col(value).cast("string"), F.lit("null")))
    return out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(bad)).otherwise(F.col(key)))


def upper_median_of(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The same by ranks over value counts: memory does not grow with a group."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(w)
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def nearest_rank(df: DataFrame, value: str, keys: list[str], percents: list[float]) -> DataFrame:
    """``sorted[round(p/100 * (n-1))]``, half to even, for each percent p; over value counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    w = Window.partitionBy(*keys)
    upto = F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("count").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100) * (F.col("total") - 1)), F.col(value))).alias(f"p{p:g}")
    return ranked.groupBy(*keys).agg(*(at(p) for p in percents))
