"""Queries that write and read files, and translation scores.

Files go to the folder that the cluster shares (``spark.checkpoint.dir``), or to a
temporary folder where none is named.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from lodestone.operators import scores as M
from lodestone.plans.registry import query, table
from lodestone.sources import readers as R
from lodestone.sources import writers as W


def scratch(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def _json_file(spark, d) -> str:
    """Lines of JSON, some blank, some broken, in order of doc_id in one file."""
    path = scratch(spark)
    row = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    line = F.when(F.col("doc_id") % 10 == 3, "").when(F.col("doc_id") % 10 == 7, F.concat(F.lit("{"), row)).otherwise(row)
    docs(spark, d).orderBy("doc_id").coalesce(1).select(line.alias("value")).write.text(path)
    return path


@query("SELECT doc_id AS line, doc_id, lang FROM documents WHERE doc_id < 200 AND doc_id % 10 NOT IN (3, 7)")
def sc1_json_lines(spark, d):
    rows, _ = R.json_lines(spark, _json_file(spark, d), "doc_id long, lang string", limit=200)
    return rows.select("line", "doc_id", "lang")


@query("SELECT doc_id AS line, 'bad JSON' AS error FROM documents WHERE doc_id % 10 = 7")
def sc2_rejected_lines(spark, d):
    """Rejected lines are kept (sk5), blank ones are neither rows nor rejects."""
    return R.json_lines(spark, _json_file(spark, d), "doc_id long, lang string")[1].select("line", "error")


@query("SELECT doc_id, n_chars FROM documents")
def sc5_parquet_shards(spark, d):
    """Shards two folders deep are found (sk1: written by size, sk4: committed whole)."""
    path = scratch(spark)
    W.shards(docs(spark, d), f"{path}/a/b", rows=100)
    return R.parquet_shards(spark, path).select("doc_id", "n_chars")


@query("""WITH l AS (SELECT l_orderkey AS id, count(*) AS length FROM lineitem GROUP BY 1) SELECT 'stored' AS kind, length, count(*) AS n FROM l GROUP BY 2
 UNION ALL SELECT 'counted', length, count(*) FROM l GROUP BY 2""")
def sc6_lengths(spark, d):
    """Lengths of token rows from their own column, and of rows that have none."""
    path = scratch(spark)
    ids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("input_ids"))
    ids.withColumn("length", F.size("input_ids")).write.parquet(path)
    stored = spark.read.parquet(path)
    by = lambda kind, df: R.with_lengths(df).groupBy(F.lit(kind).alias("kind"), F.col("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return by("stored", stored).unionByName(by("counted", stored.drop("length")))


@query(r"""WITH l AS (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), '^\s+|\s+$', '', 'g') AS text FROM documents)
 SELECT text, count(*) AS n FROM l WHERE text <> '' GROUP BY text""")
def sc11_line_segments(spark, d):
    """Lines of text files, stripped, without blank ones."""
    path = scratch(spark)
    table(spark, d, "documents").select("text").where("text IS NOT NULL").write.text(path)
    return R.text_segments(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'rows' AS kind, doc_id, NULL AS value FROM documents WHERE doc_id % 10 NOT IN (3, 7) UNION ALL
 SELECT 'rejects', doc_id, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' FROM documents WHERE doc_id % 10 = 7""")
def sk5_reject_sink(spark, d):
    """Rows and rejected lines, verbatim, written side by side and read again."""
    path = scratch(spark)
    rows, rejects = R.json_lines(spark, _json_file(spark, d), "doc_id long, lang string")
    W.with_rejects(rows, rejects, path)
    kept = spark.read.parquet(f"{path}/rows").select(F.lit("rows").alias("kind"), "doc_id", F.lit(None).cast("string").alias("value"))
    bad = spark.read.json(f"{path}/rejects").select(F.lit("rejects").alias("kind"), F.regexp_extract("value", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"), "value")
    return kept.unionByName(bad)


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 3) AS mean_chars FROM documents GROUP BY lang")
def sk10_report(spark, d):
    """A report written as one JSON file."""
    path = scratch(spark)
    W.report(docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 3).alias("mean_chars")), path)
    return spark.read.schema("lang string, n long, mean_chars double").json(path)


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def sc7_page_documents(spark, d):
    """A JSON document a source, each in a file of its own (sc8: files' names)."""
    path = scratch(spark)
    pages = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    pages.withColumn("own", F.col("source")).write.partitionBy("own").json(path)
    found = R.page_documents(spark, path, "source string, n long, chars long").select("stem", "doc.*")
    return found.join(R.stems(spark, path), "stem", "left_semi").select("source", "n", "chars")


@query("SELECT DISTINCT lang, 1 AS n_files FROM documents")
def sc9_file_listing(spark, d):
    """Files by extension at any depth: one a language here."""
    path = scratch(spark)
    docs(spark, d).repartition(1).write.partitionBy("lang").json(path)
    folder = F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")
    return R.files(spark, path, ["json"]).groupBy(folder).agg(F.count(F.lit(1)).cast("int").alias("n_files"))


@query("SELECT doc_id, substr(hex(encode(text)), 5, 10) AS part FROM documents")
def sc10_byte_spans(spark, d):
    """Spans of all documents' bytes, in hex."""
    part = R.byte_span(F.encode("text", "UTF-8"), F.lit(2), F.lit(7), 1)
    return table(spark, d, "documents").select("doc_id", F.hex(part).alias("part"))


@query("SELECT lang, min(doc_id) AS first, max(doc_id) + 5 AS past, count(*) AS n FROM documents GROUP BY lang")
def sc12_covering_spans(spark, d):
    spans = docs(spark, d).select("lang", F.col("doc_id").alias("start"), (F.col("doc_id") + 5).alias("stop"))
    return R.covering_spans(spans, "lang").select("lang", "first", "past", F.size("spans").cast("long").alias("n"))


@query("SELECT CASE WHEN doc_id % 9 = 0 THEN 'failed' END AS error, count(*) AS n FROM documents GROUP BY 1")
def sc13_score_files(spark, d):
    path = scratch(spark)
    docs(spark, d).select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 9 == 0, "failed").alias("error")).write.json(path)
    return R.score_rows(spark, path, "row long, error string").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS split, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) > 0 AS ok FROM documents")
def sk2_sorted_rewrite(spark, d):
    """Each file's rows fall in length, and files' ranges do not overlap within a split."""
    from pyspark.sql import Window

    path = scratch(spark)
    W.sorted_by_length(docs(spark, d).withColumnsRenamed({"n_chars": "length", "lang": "split"}), path, split="split")
    rows = spark.read.parquet(path).withColumns({"file": F.input_file_name(), "place": F.monotonically_increasing_id()})
    before = F.lag("length").over(Window.partitionBy("file").orderBy("place"))
    return rows.select("split", "doc_id", F.coalesce(before >= F.col("length"), F.lit(True)).alias("ok"))


@query("SELECT lang AS language_dir, source AS source_dir, count(*) AS n FROM documents GROUP BY 1, 2")
def sk3_split_folders(spark, d):
    path = scratch(spark)
    W.by_source_and_language(docs(spark, d), path, "source", "lang")
    return spark.read.parquet(path).groupBy("language_dir", "source_dir").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN doc_id % 20 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def sk6_train_and_dev(spark, d):
    path = scratch(spark)
    W.train_and_dev(docs(spark, d).withColumn("split", F.when(F.col("doc_id") % 20 == 0, "dev").otherwise("train")), path)
    return spark.read.json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS split, source AS src, count(*) AS n FROM documents GROUP BY 1, 2")
def sk7_manifest(spark, d):
    return W.manifest(docs(spark, d).withColumnsRenamed({"lang": "split", "source": "src"}), scratch(spark))


@query("""WITH RECURSIVE b AS (SELECT doc_id AS id, n_chars AS length, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
 g AS (SELECT id, length, n // 100000 AS grp, n % 100000 AS k FROM b),
 w AS (SELECT grp, k, id, length, 0 AS shard, 0::BIGINT AS pos FROM g WHERE k = 0
  UNION ALL SELECT g.grp, g.k, g.id, g.length, CASE WHEN w.pos + w.length > 0 AND w.pos + w.length + g.length > 20000 THEN w.shard + 1 ELSE w.shard END,
   CASE WHEN w.pos + w.length + g.length > 20000 THEN 0 ELSE w.pos + w.length END FROM w JOIN g ON g.grp = w.grp AND g.k = w.k + 1)
 SELECT grp, id, shard, pos AS "offset", length FROM w""")
def sk8_blob_places(spark, d):
    return W.blob_places(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length")), 20_000, scratch(spark))


@query("SELECT lang AS language_dir, count(*) AS n, count(quality) AS scored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def sk9_merged_manifests(spark, d):
    path = scratch(spark)
    W.merged_manifest(docs(spark, d), table(spark, d, "labels"), "doc_id", path, "lang")
    return spark.read.json(path).groupBy("language_dir").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("scored"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def sk11_built_once(spark, d):
    """The second call reads what the first built (sk10: a report is a small table)."""
    path = scratch(spark)
    build = lambda: docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    W.build_once(spark, path, build)
    return W.build_once(spark, path, lambda: build().limit(0))


@query("SELECT doc_id AS path FROM documents WHERE doc_id % 3 <> 0")
def sk12_pending_shards(spark, d):
    shards = docs(spark, d).select(F.col("doc_id").alias("path"))
    status = F.when(F.col("path") % 3 == 0, "done").otherwise("failed")
    return W.pending(shards, shards.select("path", status.alias("status"), F.lit(100).alias("rows_per_shard")), "path", 100)


def _pairs(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    words = F.split("text", " ")
    return t.select(F.pmod(F.col("conv_id"), F.lit(4)).alias("direction"), F.array_join(F.filter(words, lambda _, i: i % 7 != 3), " ").alias("pred"), F.col("text").alias("ref"))


@query()
def a15_pooled_scores(spark, d):
    """BLEU and chrF++ of each direction over pooled statistics."""
    out = M.pooled(_pairs(spark, d), ["direction"])
    return out.select("direction", "n", F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"))


@query()
def a14_macro_scores(spark, d):
    out = M.macro(M.pooled(_pairs(spark, d), ["direction"]))
    return out.select("n", F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"))
