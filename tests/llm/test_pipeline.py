"""The pipeline against its stages by slow versions, and on odd tables."""

import shutil

import pytest
from oracle import connect
from test_text_operators import slow_components

import corpus_pipeline as p
from lodestone.llm import quality_classifier, queries, secrets, wordids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def tokens_of(rows):
    w = wordids.word_ids(wordids.vocabulary())
    return {d: len(w.ids(secrets.masked(t or "").encode())) + 1 for d, t in rows}


def lengths(pieces):
    out = {}
    for r in pieces.collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + r["length"]
    return out


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality_classifier.quality_report(docs, labels).where("kept").collect()}
    ruled = {d for (d,) in connect(sf_dir).execute(f"SELECT doc_id FROM ({queries.ORACLES['op8_quality_rules']}) WHERE kept").fetchall()}
    left = sorted(good & ruled)
    one = {c for _, _, c in slow_components([(d, texts[d]) for d in left])}
    assert lengths(p.run(spark, sf_dir)) == tokens_of((d, texts[d]) for d in one)
    assert len(one) < len(left) < len(texts)


def test_stages_are_named_in_order():
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "quality_rules", "simhash", "secrets", "packing"]


@pytest.mark.parametrize("labels", ["sf", "none"])
def test_odd_rows_clashing_names_and_empty_tables(spark, sf_dir, odd_docs, tmp_path, labels):
    """Null ids, texts and sites, repeated rows, a very long text, columns that operators use themselves."""
    prose = " ".join(f"word{k % 997} of{k}" for k in range(40_000))
    more = [(90, prose, "en", None, len(prose), "x"), (None, prose[5:], "en", "src0", 1, "x"), (None, "other " + prose, None, "src0", None, "x")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    docs = docs.selectExpr("*", "1 AS odds", "2 AS score", "3 AS `__found`", "4 AS `__row`", "5 AS `__fp`", "6 AS n_words")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, table in (("some", docs), ("empty", docs.limit(0))):
        d = tmp_path / name
        table.write.parquet(f"{d}/documents.parquet")
        (known if labels == "sf" else known.limit(0)).write.parquet(f"{d}/labels.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            before, now = now, stage(spark, now, str(d))
            assert now.columns == docs.columns
            assert now.where("odds <> 1 OR score <> 2 OR `__found` <> 3 OR `__row` <> 4 OR `__fp` <> 5 OR n_words <> 6").count() == 0
            assert now.count() <= before.count()
        out = p.run(spark, str(d))
        if name == "empty":
            assert out.count() == 0
        elif labels == "none":  # the classifier rejects nothing: what the rules leave are the long texts
            kept = {(r["doc_id"], r["text"]) for r in now.collect()}
            assert {d for d, _ in kept} >= {90}
            assert sum(lengths(out).values()) == sum(tokens_of([(d, t)])[d] for d, t in kept)
        shutil.rmtree(d)
