"""Queries over rows of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import strings as S
from lodestone.operators import corpus as C
from lodestone.operators.running import numbered
from lodestone.plans.files import scratch
from lodestone.plans.registry import query, table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BUCKET = "CAST(((('0x' || substr(md5({0}),1,16))::UBIGINT % 100) * 16 + (('0x' || substr(md5({0}),17,16))::UBIGINT % 100)) % 100 AS INTEGER)"
_SPLIT = f"CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'val' ELSE 'test' END"
_STEM = "source || '_' || doc_id"


def docs(spark, d):
    return table(spark, d, "documents")


def stem():
    return F.concat_ws("_", "source", "doc_id")


@query(f"""
WITH s AS (SELECT *, {_STRIP.format("text")} AS t FROM documents),
u AS (SELECT * FROM s WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1),
p AS (SELECT lang, {_SPLIT.format(_STEM)} AS split FROM u)
SELECT lang, split, count(*) AS n_docs FROM p GROUP BY lang, split""")
def p0_corpus_splits(spark, d):
    kept = C.first_occurrence(C.drop_empty(docs(spark, d), "text"), ["text"], ["doc_id"], keep=["doc_id", "lang", "source"])
    return C.with_hash_split(kept, stem()).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT min(doc_id) AS doc_id, text, count(*) > 0 AS kept FROM documents WHERE text IS NOT NULL GROUP BY text")
def w1_first_occurrence(spark, d):
    kept = C.first_occurrence(docs(spark, d).where("text IS NOT NULL"), ["text"], ["doc_id"])
    return kept.select("doc_id", "text", F.lit(True).alias("kept"))


@query("""
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY CASE WHEN source <> '' THEN source ELSE text || lang END, n_chars ORDER BY doc_id) = 1""")
def w2_dedup_by_path_else_text(spark, d):
    key = F.when(F.col("source") != "", F.col("source")).otherwise(F.concat("text", "lang"))
    return C.first_occurrence(docs(spark, d).select("doc_id", "source", "text", "lang", "n_chars"), [key, "n_chars"], ["doc_id"]).select("doc_id", "source")


@query(f"SELECT doc_id, {_BUCKET.format(_STEM)} AS bucket, {_SPLIT.format(_STEM)} AS split FROM documents")
def n1_hash_split(spark, d):
    out = C.with_hash_split(docs(spark, d), stem())
    return out.select("doc_id", S.md5_bucket(stem()).alias("bucket"), "split")


@query(f"""
SELECT doc_id, CASE WHEN source IN ('src0','src1') THEN (CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END)
 WHEN source IN ('src2','src3') THEN (CASE WHEN doc_id % 11 = 0 THEN 'test' WHEN doc_id % 7 = 0 THEN 'val' ELSE 'train' END)
 ELSE {_SPLIT.format(_STEM)} END AS split FROM documents""")
def n6_policy_split(spark, d):
    policy = F.when(F.col("source").isin("src0", "src1"), "native").when(F.col("source").isin("src2", "src3"), "holdout").otherwise("hash")
    native = F.when(F.col("lang") == "en", "train").otherwise("test")
    held = lambda k: F.col("doc_id") % k == 0
    return C.with_policy_split(docs(spark, d), policy, native, held(7), held(11), stem()).select("doc_id", "split")


@query(f"""
SELECT {_STEM} AS stem, source AS src, lang AS domain, {_SPLIT.format(_STEM)} AS split,
  CASE WHEN source = 'src0' THEN 'images/' || {_SPLIT.format(_STEM)} || '/' || {_STEM} || '.jpg' ELSE 'images/' || {_STEM} || '.jpg' END AS image FROM documents""")
def n7_page_manifest(spark, d):
    out = C.with_hash_split(docs(spark, d).withColumn("stem", stem()), stem())
    folder = F.when(F.col("source") == "src0", F.concat(F.lit("images/"), "split", F.lit("/"))).otherwise("images/")
    return out.select("stem", F.col("source").alias("src"), F.col("lang").alias("domain"), "split", F.concat(folder, "stem", F.lit(".jpg")).alias("image"))


@query(f"""
WITH p AS (SELECT source, {_SPLIT.format(_STEM)} AS split FROM documents)
SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test FROM p GROUP BY source""")
def a3_split_counts(spark, d):
    out = C.with_hash_split(docs(spark, d), stem()).groupBy("source").pivot("split", ["train", "val", "test"]).count()
    return out.na.fill(0)


@query(f"""
WITH p AS (SELECT source, {_SPLIT.format(_STEM)} AS split FROM documents)
SELECT source AS prefix, count(DISTINCT split) AS n_splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def a4_straddling_prefixes(spark, d):
    return C.straddling(C.with_hash_split(docs(spark, d), stem()), stem())


@query(f"SELECT doc_id FROM documents WHERE {_SPLIT.format(_STEM)} = 'val' INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def u5_overlap_check(spark, d):
    """Documents of the validation split that are pinned elsewhere."""
    held = C.with_hash_split(docs(spark, d), stem()).where("split = 'val'")
    return C.overlapping(held, table(spark, d, "labels").where("quality = 0"), "doc_id")


@query("SELECT source AS name, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def u5_duplicate_names(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""
WITH s AS (SELECT *, {_STRIP.format("coalesce(text, '')")} AS t FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM s)
SELECT source, count(*) AS n_read, count(*) FILTER (t = '') AS n_empty, count(*) FILTER (t <> '' AND k > 1) AS n_duplicate,
  count(*) FILTER (t <> '' AND k = 1) AS n_kept FROM u GROUP BY source""")
def a1_reject_accounting(spark, d):
    """Every row is kept, empty or a duplicate of the first with its text."""
    t = S.strip(F.coalesce("text", F.lit("")))
    rows = docs(spark, d).select("doc_id", "source", C.digest(t).alias("t"), (t == "").alias("empty"))  # texts stay where they are
    first = rows.groupBy("t").agg(F.min("doc_id").alias("first"))
    rows = rows.join(first, "t")
    empty = F.col("empty")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(~empty & (F.col("doc_id") != F.col("first"))).alias("n_duplicate"),
        F.count_if(~empty & (F.col("doc_id") == F.col("first"))).alias("n_kept"),
    )


@query("""
SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars,
  list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY lang""")
def a2_upper_median_summary(spark, d):
    median = C.upper_median_of(docs(spark, d), "n_chars", ["lang"])
    totals = docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return totals.join(median, "lang")


@query("""
SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars
FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def a2_summary_grouping_sets(spark, d):
    return spark.sql(
        "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, sum(n_chars) AS n_chars "
        "FROM {rows} GROUP BY GROUPING SETS ((source), (lang), ())",
        rows=docs(spark, d),
    )


@query("""
SELECT c.class AS class FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'hi', 'ta']) AS class) c
WHERE c.class NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)""")
def u4_absent_classes(spark, d):
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, ["en", "fr", "de", "es", "hi", "ta"]))).alias("class"))
    return known.join(docs(spark, d).select(F.col("lang").alias("class")).distinct(), "class", "left_anti")


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def u3_difference(spark, d):
    return table(spark, d, "labels").select("doc_id").distinct().exceptAll(docs(spark, d).where("lang = 'en'").select("doc_id").distinct())


@query("SELECT doc_id, lang AS kind, 0 AS ord FROM documents UNION ALL SELECT conv_id AS doc_id, role AS kind, 1 AS ord FROM conversations")
def u1_ordered_union(spark, d):
    a = docs(spark, d).select("doc_id", F.col("lang").alias("kind"), F.lit(0).alias("ord"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("kind"), F.lit(1).alias("ord"))
    return a.unionByName(b)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def sc3_shard_and_resume(spark, d):
    return C.resume(C.shard(docs(spark, d).select("doc_id"), "doc_id", 4, 1), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4_anti_join(spark, d):
    return C.resume(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""
SELECT d.doc_id AS doc_id, l.quality AS quality, CASE WHEN l.doc_id IS NULL THEN 'no_label' END AS error
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j1_plan_with_results(spark, d):
    return C.with_results(docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", "no_label")


@query("SELECT d.doc_id AS doc_id, d.source AS source, l.quality AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j2_lookup_join(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("""WITH a AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
 b AS (SELECT doc_id AS other, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents) SELECT position, doc_id, lang, other FROM a JOIN b USING (position)""")
def j3_positional_join(spark, d):
    """The k-th document by id beside the k-th by length; sides of unequal length raise."""
    other = docs(spark, d).select(F.col("doc_id").alias("other"), "n_chars")
    return C.zipped(docs(spark, d).select("doc_id", "lang"), ["doc_id"], other, [F.desc("n_chars"), "other"], scratch(spark)).drop("n_chars")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 700")
def sc4_contiguous_shards(spark, d):
    """The first 700 rows of a table in shards of 64."""
    return C.contiguous_shards(docs(spark, d).select("doc_id"), ["doc_id"], 64, scratch(spark), most=700)


@query("""
SELECT conv_id, turn, CASE lower(role) WHEN 'user' THEN 'voice_a' WHEN 'assistant' THEN 'voice_b' ELSE role END AS voice FROM conversations""")
def j5_speaker_voices(spark, d):
    voices = F.create_map(F.lit("user"), F.lit("voice_a"), F.lit("assistant"), F.lit("voice_b"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(voices[F.lower("role")], "role").alias("voice"))


@query("""
SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey""")
def j12_checked_lookup(spark, d):
    region = table(spark, d, "region").select("r_regionkey")
    return C.known_or_raise(table(spark, d, "nation"), "n_regionkey", region, "r_regionkey").select("n_nationkey", "r_regionkey")


@query("""
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'test'
 WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'val' ELSE 'train' END AS split FROM documents""")
def j13_pinned_holdout(spark, d):
    labels = table(spark, d, "labels")
    held = labels.groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    out = docs(spark, d).select("doc_id").join(held, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("t") == 1, "test").when(F.col("q") == 0, "val").otherwise("train").alias("split"))


@query("""
WITH b AS (SELECT o_orderkey AS row, o_orderpriority AS text, 'audio/' || substr(o_orderstatus || '_' || (o_custkey % 50), 1) || '.wav' AS base FROM orders),
w AS (SELECT *, first_value(text) OVER (PARTITION BY base ORDER BY row) AS owner FROM b)
SELECT row, CASE WHEN owner <> text THEN replace(base, '.wav', '') || '__' || row || '.wav' ELSE base END AS target, base LIKE 'audio/F%' AND owner = text AS skip FROM w""")
def pf16_output_plan(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("text"), "o_orderstatus", "o_custkey")
    base = F.concat(F.lit("audio/"), "o_orderstatus", F.lit("_"), (F.col("o_custkey") % 50).cast("string"), F.lit(".wav"))
    done = rows.where("o_orderstatus = 'F'").select(base.alias("path"))
    return C.output_plan(rows, "row", base, "text", done).select("row", "target", "skip")


@query("""
SELECT doc_id, CASE WHEN length(doc_id::VARCHAR) > 4 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 4, '0') END || '_' ||
 substr(sha256(encode(source) || '\\x00'::BLOB || encode(text)), 1, 8) || '.wav' AS name FROM documents""")
def pf17_output_names(spark, d):
    return docs(spark, d).select("doc_id", S.output_name(F.col("doc_id"), F.col("source"), F.col("text")).alias("name"))


@query(f"""
SELECT o_orderkey, CASE WHEN b = '' THEN 'unknown' ELSE b END AS segment FROM (SELECT o_orderkey,
 regexp_replace(regexp_replace(o_orderpriority || '/' || o_orderstatus || '..', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS b FROM orders)""")
def t13_path_segment(spark, d):
    value = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(".."))
    return table(spark, d, "orders").select("o_orderkey", S.path_segment(value).alias("segment"))


@query(f"""
SELECT conv_id, turn, CASE WHEN {_STRIP.format("coalesce(p, '')")} = '' THEN true WHEN length(p) < 200 THEN false
 ELSE length(s) > 0 AND length(s) / length(p) < 0.15 END AS degenerate FROM (SELECT u.conv_id AS conv_id, u.turn AS turn, a.text AS p, u.text AS s
 FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')""")
def pf6_degenerate(spark, d):
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("p"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", S.degenerate(F.col("p"), F.col("s")).alias("degenerate"))


@query(f"SELECT doc_id, {_STRIP.format('text')} AS text FROM documents WHERE {_STRIP.format('text')} <> ''")
def pf1_strip_drop_empty(spark, d):
    return C.drop_empty(docs(spark, d).select("doc_id", "text"), "text")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def o5_ordinal_limit(spark, d):
    return docs(spark, d).select("doc_id", "n_chars").orderBy("doc_id").limit(25)


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents")
def o1_length_order(spark, d):
    """The whole sort, longest first (o6)."""
    return numbered(docs(spark, d).select("doc_id", "n_chars"), [], [F.desc("n_chars"), F.asc("doc_id")], scratch(spark), "rank")


@query("SELECT doc_id, doc_id % 8 AS shard FROM documents")
def o8_round_robin(spark, d):
    return docs(spark, d).select("doc_id", F.pmod(F.col("doc_id"), F.lit(8)).cast("long").alias("shard"))


@query("""
SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) - 1) / 32) AS BIGINT) AS batch FROM documents""")
def o2_language_batches(spark, d):
    rows = numbered(docs(spark, d).select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.desc("doc_id")], scratch(spark))
    return rows.select("doc_id", "lang", F.floor(F.col("k") / 32).alias("batch"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = round_even(0.5 * (n - 1), 0) + 1) AS p50, max(value) FILTER (k = round_even(0.9 * (n - 1), 0) + 1) AS p90,
 max(value) FILTER (k = round_even(0.99 * (n - 1), 0) + 1) AS p99 FROM r GROUP BY event_type""")
def a11_nearest_rank_percentiles(spark, d):
    return C.nearest_rank(table(spark, d, "events"), "value", ["event_type"], [50, 90, 99])


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (k = round_even(0.5 * (n - 1), 0) + 1) AS p50,
 max(value) FILTER (k = round_even(0.9 * (n - 1), 0) + 1) AS p90, max(value) FILTER (k = round_even(0.99 * (n - 1), 0) + 1) AS p99 FROM r GROUP BY event_type""")
def a12_benchmark_summary(spark, d):
    e = table(spark, d, "events")
    ranks = C.nearest_rank(e, "value", ["event_type"], [50, 90, 99])
    plain = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return plain.join(ranks, "event_type")


@query("SELECT source, round(sum(n_chars) / 1000.0, 6) AS kchars, count(*) AS n FROM documents GROUP BY source")
def a19_global_sums(spark, d):
    return docs(spark, d).groupBy("source").agg(F.round(F.sum("n_chars") / 1000.0, 6).alias("kchars"), F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(CASE WHEN n_chars > 8192 THEN 1.0 ELSE 0.0 END), 9) AS oversize_share, avg(CASE WHEN n_chars > 8192 THEN 1.0 ELSE 0.0 END) > 0.01 AS too_many FROM documents")
def a20_oversize_share(spark, d):
    share = F.avg(F.when(F.col("n_chars") > 8192, 1.0).otherwise(0.0))
    return docs(spark, d).agg(F.round(share, 9).alias("oversize_share"), (share > 0.01).alias("too_many"))


@query("""
WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT max(n) AS most FROM s)
SELECT lang, round(least(5.0, greatest(0.5, sqrt(most / n))), 6) AS weight FROM s, m""")
def a22_class_weights(spark, d):
    from pyspark.sql import Window

    n = docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # one row a class
    return n.select("lang", F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.sqrt(most / F.col("n")))), 6).alias("weight"))


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n,
 date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000000.0 AS gap FROM events),
g AS (SELECT user_id, gap, k - 1 AS j, n - 1 AS m FROM e WHERE gap IS NOT NULL)
SELECT user_id, count(*) AS n_gaps, round(avg(gap), 3) AS mean_gap,
 CASE WHEN count(*) >= 4 THEN round(avg(gap) FILTER (j >= m // 2) - avg(gap) FILTER (j < m // 2), 3) END AS drift FROM g GROUP BY user_id""")
def a13_session_drift(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, d, "events").select("user_id", "ts", "event_id", ((us - F.lag(us).over(w)) / 1e6).alias("gap"))
    g = g.where("gap IS NOT NULL").withColumn("j", F.row_number().over(w) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    late = F.col("j") >= F.floor(F.col("m") / 2)
    drift = F.round(F.avg(F.when(late, F.col("gap"))) - F.avg(F.when(~late, F.col("gap"))), 3)
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.round(F.avg("gap"), 3).alias("mean_gap"), F.when(F.count(F.lit(1)) >= 4, drift).alias("drift"))
