from lodestone.operators import corpus as C
from lodestone.operators.running import numbered
from lodestone.plans import catalog


def test_ranks_are_of_all_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", (F.col("id") * 7 % 40).alias("length")).repartition(7)
    got = numbered(rows, [], [F.desc("length"), F.asc("id")], f"file://{tmp_path}/ranked", "rank").collect()
    want = sorted(got, key=lambda r: (-r["length"], r["id"]))
    assert len(got) == 3000 and [r["rank"] for r in want] == list(range(3000))


def test_every_document_has_a_rank(spark, sf_dir):
    got = catalog.QUERIES["o1_length_order"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() > 100


def test_byte_spans_are_of_all_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert any(not (t or "").isascii() for t in docs.values())
    got = {r["doc_id"]: r["part"] for r in catalog.QUERIES["sc10_byte_spans"](spark, sf_dir).collect()}
    assert got == {d: None if t is None else t.encode()[2:7].hex().upper() for d, t in docs.items()}
