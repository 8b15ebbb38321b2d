"""The quality classifier's posteriors against a slow computation, and its accuracy on labels it has not seen."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_classifier as Q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")


def slow_priors(rows):
    """For each (host, path, p) the posterior rate of its path, without the row itself."""
    host, path = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        host[h].append(p)
        path[h, q].append(p)
    n, mean = len(rows), min(max(sum(p for *_, p in rows) / len(rows), 1e-3), 1 - 1e-3)
    within = mean * (1 - mean)

    def strength(spread, free):
        return min(max(within / max((spread - within * free) / n, 1e-9) - 1, 1.0), 1e6)

    a = strength(sum(len(v) * (np.mean(v) - mean) ** 2 for v in host.values()), len(host) - 1)
    b = strength(sum(len(v) * (np.mean(v) - np.mean(host[k[0]])) ** 2 for k, v in path.items()), len(path) - len(host))
    out = []
    for h, q, p in rows:
        rate = (sum(host[h]) - p + a * mean) / (len(host[h]) - 1 + a)
        out.append((sum(path[h, q]) - p + b * rate) / (len(path[h, q]) - 1 + b))
    return out


def test_scores_equal_a_slow_computation(docs, labels):
    model = Q.fit(docs, labels)
    sites = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.select("doc_id", "source", "lang").collect()}
    rows = Q.quality_report(docs, labels).collect()
    want = slow_priors([(*sites[r["doc_id"]], r["classifier"]) for r in rows])
    logit = lambda p: math.log(p / (1 - p))
    for r, prior in zip(rows, want, strict=True):
        assert r["site_prior"] == pytest.approx(prior, rel=1e-9)
        score = logit(r["classifier"]) - model["base"] + logit(prior)
        assert logit(r["score"]) == pytest.approx(score, abs=1e-6) and r["kept"] == (r["score"] >= 0.5)
    odds = {r["doc_id"]: r["classifier"] for r in rows}
    for r in docs.limit(50).collect():
        z = ((Q.features((r["text"] or "").encode()) - model["mean"]) / model["spread"]).clip(-8, 8)
        assert odds[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(model["w"][0] + z @ model["w"][1:]))), rel=1e-9)


def test_labels_not_seen_are_met(docs, labels):
    right = n = 0
    for k in range(4):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k
        got = Q.quality_report(docs, labels.where(~mine)).join(labels.where(mine), "doc_id")
        a, b = got.agg(F.count_if(F.col("kept") == (F.col("quality") == 1)), F.count(F.lit(1))).first()
        right, n = right + a, n + b
    assert n == labels.count() and right / n > 0.93


def test_sparse_sites_take_their_hosts_rate(spark):
    rows = [(i, "good" if i % 2 else "bad", f"p{i % 40}" if i < 4000 else f"rare{i}") for i in range(4100)]
    df = spark.createDataFrame([(h, p, 0.9 if h == "good" else 0.1) for _, h, p in rows], "host string, path string, p double")
    sites, found = Q.site_table(df)
    assert found["hosts"] < 2 and found["paths"] > 1000  # hosts differ, paths of a host do not
    one = {r["host"]: r["prior"] for r in sites.where("path LIKE 'rare%'").select("host", Q.prior_without(F.when(F.col("host") == "good", 0.9).otherwise(0.1), F.struct(*sites.columns), found).alias("prior")).distinct().collect()}
    assert one["good"] > 0.88 and one["bad"] < 0.12


def test_sparse_sites_shrink_toward_their_host(spark):
    rows = [("a", "x", 0.9)] * 300 + [("a", "y", 0.1)] + [("b", "x", 0.2)] * 300 + [("b", "z", 0.9)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    sites, found = Q.site_table(df)
    prior = Q.prior_without(F.col("p"), F.struct(*sites.columns), found)
    got = {(r["host"], r["path"]): r["prior"] for r in df.join(sites, ["host", "path"]).select("host", "path", prior.alias("prior")).distinct().collect()}
    assert got["a", "x"] > 0.8 > 0.3 > got["b", "x"]
    assert got["a", "y"] > 0.1 and got["b", "z"] < 0.9


def test_odd_rows_and_clashing_names(spark, docs, labels, odd_docs, no_docs):
    names = ["odds", "prior", "score", "host", "path", "n", "good", "__found", "__site", "classifier"]
    clash = odd_docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for some in (labels, labels.limit(0)):
        kept = Q.quality_filter(clash, some)
        assert kept.columns == clash.columns
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in kept.collect())
        assert Q.quality_report(clash, some).count() == clash.count()
        assert Q.quality_filter(no_docs, some).count() == Q.quality_report(no_docs, some).count() == 0
    assert Q.quality_filter(clash, labels.limit(0)).count() == clash.count()
    twice = docs.unionByName(docs)
    assert Q.quality_report(twice, labels.unionByName(labels)).count() == twice.count()


def test_sites_of_urls(spark):
    urls = ["https://User@News.Example.org:80/World/a?b#c", "http://x.y", "ftp://h/one", "no url", None]
    df = spark.createDataFrame([(k, u, f"some words {k}") for k, u in enumerate(urls)], "doc_id long, url string, text string")
    host, path = Q.url_site(F.col("url"))
    got = [tuple(r) for r in df.select(host, path).collect()]
    assert got == [("news.example.org", "World"), ("x.y", None), ("h", "one"), (None, None), (None, None)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_report(df, none, host=host, path=path).count() == 5
