"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import lm

    return lm.score(documents(spark, sf_dir))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import embedding_dedup

    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pieces

    return pieces.digest(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality_rules as q

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return q.quality_report(docs).select("doc_id", *q.COUNTS, "base_failed", "kept")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import simhash

    found = simhash.near_duplicates(documents(spark, sf_dir))
    # The bits are stored as a signed long; hex() shows them unsigned.
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality_classifier

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_report(documents(spark, sf_dir), labels)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import packing

    return packing.pack(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import secrets

    return secrets.report(documents(spark, sf_dir).select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_files

    return token_files.digest(spark, token_files.write_tokens(documents(spark, sf_dir)))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quotes

    return quotes.format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "op10_quotation_linking": op10_quotation_linking,
}

ORACLES: dict[str, str] = {}

ORACLES["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
g AS (SELECT k, i, list_slice(ws, i, i + 2) AS win FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM g) WHERE n > 1),
p AS (SELECT k, count(DISTINCT i + o) AS n FROM r, unnest([0, 1, 2]) AS v(o) GROUP BY k),
c AS (SELECT w.*, len(ws) AS n_words,
    length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN p ON w.k = p.k),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed
    OR length(regexp_replace(t, '[^#*$%&<>]+', '', 'g')) > n_words
    OR 2 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > word_chars
    OR 2 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
    OR word_chars > 40 * n_words
    OR 10 * n_dup_lines > 8 * len(string_split(t, chr(10)))) AS kept
FROM b
"""
