"""Scans of JSON lines, Parquet shards, page files and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import strings as S


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(line, value): physical lines numbered from 0 in file order.

    Partitions of a text scan are runs of lines in order, so a line's number is the
    number of lines in the partitions before plus its place in its own: two passes
    over the text, no shuffle.
    """
    lines = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    # An id is the partition in its upper bits and the place in its lower 33.
    lines = lines.withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not before:
        return lines.select(F.col("place").alias("line"), "value")
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    out = lines.select((offset[F.col("part")] + F.col("place")).alias("line"), "value")
    return out if limit is None else out.where(F.col("line") < limit)


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None, blank: str = "skip", bad: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Rows with their ``line`` of a JSON-lines file, and its rejected lines (line, value, error).

    ``limit`` counts physical lines. ``blank``: skip, raise; ``bad``: reject, raise.
    """
    kinds = StructType.fromDDL(schema).add("_bad", "string")
    lines = numbered_lines(spark, path, limit)
    empty = F.trim("value") == ""
    parsed = lines.where(~empty).withColumn("row", F.from_json("value", kinds, {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("row").isNull() | F.col("row._bad").isNotNull()
    message = F.concat(F.lit("bad JSON in line "), F.col("line").cast("string"))
    if bad == "raise":
        parsed = parsed.withColumn("row", F.when(broken, F.raise_error(message)).otherwise(F.col("row")))
        rows = parsed
    else:
        rows = parsed.where(~broken)
    rejects = parsed.where(broken).select("line", "value", F.lit("bad JSON").alias("error"))
    if blank == "raise":
        found = lines.where(empty)
        if row := found.first():
            raise ValueError(f"blank line {row['line']}")
    return rows.select("line", "row.*").drop("_bad"), rejects


def parquet_shards(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Shards directly in a folder, else those at any depth; none is an error."""
    from pyspark.errors import AnalysisException

    reader = spark.read.option("pathGlobFilter", pattern)
    try:
        return reader.parquet(path)
    except AnalysisException:
        return reader.option("recursiveFileLookup", "true").parquet(path)


def with_lengths(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Rows' lengths: the stored column if there is one, so that no ids are read."""
    return df.select("length") if "length" in df.columns else df.select(F.size(ids).alias("length"))


def page_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(src, stem, doc): a JSON document a file, keyed by its folder's parent and its name; an unreadable one is null."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    parts = F.split(F.input_file_name(), "/")
    files = files.select(F.element_at(parts, -3).alias("src"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("stem"), "value")
    return files.select("src", "stem", F.from_json("value", schema).alias("doc"))


def stems(spark: SparkSession, path: str, extension: str = "json") -> DataFrame:
    """(stem) of files of an extension; only names are read, not contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"))


def files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """(path, length) of files at any depth, by extension in either case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions)).select("path", "length")


def text_segments(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(text): each line that is not blank, stripped, or each whole file."""
    out = spark.read.option("wholetext", str(whole).lower()).text(path).select(S.strip("value").alias("text"))
    return out.where("text <> ''")


def score_rows(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of JSON score files; rows with an error are kept apart by ``error``."""
    return spark.read.schema(schema).json(pattern)


def byte_span(data: Column, start: Column, stop: Column, width: int = 2) -> Column:
    """Samples [start, stop) of PCM bytes."""
    return F.substring(data, start * width + 1, (stop - start) * width)


def covering_spans(spans: DataFrame, key: str) -> DataFrame:
    """One read a file: (key, first, past, spans) that covers all its spans (start, stop)."""
    return spans.groupBy(key).agg(F.min("start").alias("first"), F.max("stop").alias("past"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
