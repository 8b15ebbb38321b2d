"""Sinks: sharded and sorted Parquet, rejects, splits, blobs, manifests, resume ledgers.

Spark's commit protocol makes a write atomic by task and by job, so no sink
renames files itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import strings as S
from lodestone.operators.running import numbered
from lodestone.operators.runs import per_group

ROWS_A_FILE = 100_000


def shards(df: DataFrame, path: str, rows: int = ROWS_A_FILE, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "snappy").parquet(path)


def sorted_by_length(df: DataFrame, path: str, length: str = "length", split: str | None = None, rows: int = ROWS_A_FILE) -> None:
    """Longest rows first over the whole output (of each split), by ranges rather than on one task."""
    keys = ([split] if split else []) + ["__longest"]
    out = df.withColumn("__longest", -F.col(length)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__longest")
    writer = out.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("parquet.block.size", 64 << 20)
    (writer.partitionBy(split) if split else writer).parquet(path)


def by_source_and_language(df: DataFrame, path: str, source: str = "source", language: str = "language") -> None:
    """Folders by source and language, whose names are made safe; a source that the folder is called after is left out."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    out = df.withColumns({"source_dir": S.path_segment(F.col(source)), "language_dir": S.path_segment(F.col(language))})
    redundant = out.where(F.col("source_dir") != name).limit(1).count() == 0
    folders = ["language_dir"] if redundant else ["source_dir", "language_dir"]
    (out.drop("source_dir") if redundant else out).write.mode("errorifexists").partitionBy(*folders).parquet(path)


def with_rejects(good: DataFrame, rejects: DataFrame, path: str) -> None:
    """Kept rows as Parquet under ``rows``, rejected ones verbatim as JSON lines under ``rejects``."""
    good.write.parquet(f"{path}/rows")
    rejects.write.json(f"{path}/rejects")


def train_and_dev(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder a split."""
    df.write.partitionBy(split).json(path)


def manifest(pages: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Manifests as JSON by split; returns the counts (split, source, n)."""
    pages.write.partitionBy(split).json(path)
    return pages.groupBy(split, "src").agg(F.count(F.lit(1)).alias("n"))


def blob_places(files: DataFrame, shard_bytes: int, path: str, files_per_group: int = 100_000) -> DataFrame:
    """(grp, id, shard, offset, length) of blobs (id, length) packed in order of id.

    A shard that has some rolls over before it would overflow. Each run of
    ``files_per_group`` files in a row packs shards of its own.
    """

    def place(group: dict) -> dict:
        shard, at, shards_, offsets = 0, 0, [], []
        for n in group["length"].tolist():
            if at and at + n > shard_bytes:
                shard, at = shard + 1, 0
            shards_.append(shard)
            offsets.append(at)
            at += n
        return {"grp": group["grp"], "id": group["id"], "shard": shards_, "offset": offsets, "length": group["length"]}

    dealt = numbered(files.select("id", "length"), [], ["id"], path).withColumn("grp", F.floor(F.col("k") / files_per_group)).drop("k")
    return per_group(dealt, ["grp"], ["id"], place, "grp long, id long, shard int, offset long, length long")


def merged_manifest(plan: DataFrame, results: DataFrame, key: str, path: str, language: str = "language") -> None:
    """All rows of a plan with their results, in one folder a language."""
    out = plan.join(results, key, "left").withColumn("language_dir", S.path_segment(F.col(language)))
    out.write.partitionBy("language_dir").json(path)


def report(df: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file."""
    df.coalesce(1).write.json(path)


def build_once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at a path, built if it is not there; of two builders at once one fails and reads the other's."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        pass
    try:
        build().write.mode("errorifexists").parquet(path)
    except AnalysisException:  # built meanwhile
        pass
    return spark.read.parquet(path)


def pending(shards_: DataFrame, ledger: DataFrame | None, key: str = "path", rows_per_shard: int | None = None) -> DataFrame:
    """Shards that no ledger row marks done; a ledger made with another shard size is refused."""
    if ledger is None:
        return shards_
    if rows_per_shard is not None and ledger.where(F.col("rows_per_shard") != rows_per_shard).limit(1).count():
        raise ValueError("the ledger was made with another number of rows a shard")
    return shards_.join(ledger.where("status = 'done'").select(key).distinct(), key, "left_anti")
