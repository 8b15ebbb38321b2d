"""Quality classifier: document evidence and site posteriors, by hierarchical empirical Bayes.

A logistic model over surface features of the whole text gives each document's
log odds of good quality. It is fitted in numpy on labelled rows, at most
``TRAIN_ROWS`` of them, taken by hash order of doc_id: this sample is the only
thing that the driver receives. Features are computed once a text and the odds
written beside it. Every document's probability then counts for its host and
its path. Grouped aggregation gives per host and per path the number of
documents and the sum of probabilities; a host's posterior is shrunk toward the
global rate and a path's toward its host's, by as many pseudo-documents as the
spread of hosts around the global rate, and of paths around their host's,
implies (method of moments). A document's prior is its path's posterior without
the document itself, whose evidence is the classifier's log odds less the
training sample's base rate; the score adds the two.

Host and path are any two columns, by default ``source`` and ``lang``, which are
what ``documents`` has of a site; ``url_site`` gives those of a URL.

Site tables are joined back by broadcast if their counted rows are at most
``BROADCAST_SITES``, else by a shuffled join; a hot host is one row there, and
its documents are pre-aggregated before the shuffle.

Defined results: a null text counts as empty; a null host or path is a site of
its own; labels without a row are ignored and of repeated labels the mean
counts (good if 0.5 or more); with no labels of both kinds, nothing is
rejected; repeated rows each get a row; an empty table gives an empty table;
``quality_filter`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_bytes, unused, written

#: Most labelled rows that the classifier is fitted on.
TRAIN_ROWS = 20_000
BROADCAST_SITES = 100_000
#: Documents with a lower probability of good quality are rejected.
KEEP = 0.5
RIDGE = 1e-2

_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b"#*$%&<>",
    b"|",
    b"!?",
    b".,;:",
    bytes(range(128, 256)),
)
FEATURES = len(_CLASSES) + 7


def _class_of() -> np.ndarray:
    out = np.full(256, len(_CLASSES))
    for k, members in enumerate(_CLASSES):
        out[list(members)] = k
    return out


_CLASS_OF = _class_of()


def features(text: bytes) -> np.ndarray:
    """Shares of byte classes, words' length and variety, lines and their repetition."""
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    by = np.bincount(_CLASS_OF, weights=counts, minlength=len(_CLASSES) + 1)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, size = max(len(words), 1), max(len(text), 1)
    return np.concatenate(
        (
            by / size,
            (
                np.log1p(len(words)),
                len(text) / n,
                len(set(words)) / n,
                len(set(lines)) / max(len(lines), 1),
                len(lines) / n,
                by[5] / n,
            ),
        )
    )


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y): at most ``rows`` labelled documents, by hash order of doc_id."""
    y = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """Weights of the logistic model on standardised features; None without both kinds of labels."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [features(t) for t in text_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    found = labelled(docs, labels, rows).mapInArrow(run, "x array<double>, y int").toArrow()
    y = found.column("y").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array(found.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), ((x - mean) / spread).clip(-8, 8)])
    w, ridge = np.zeros(z.shape[1]), RIDGE * len(y) * np.eye(z.shape[1]) / 10
    ridge[0, 0] = 1e-6
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = y.mean()
    return {"mean": mean, "spread": spread, "w": w, "base": float(np.log(rate / (1 - rate)))}


def log_odds(text: Column, model: dict | None) -> Column:
    """The classifier's log odds that a text is good."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf(T.DoubleType())
    def score(texts):
        import pandas as pd

        x = np.array([features((t or "").encode()) for t in texts]).reshape(len(texts), -1)
        z = ((x - model["mean"]) / model["spread"]).clip(-8, 8) if len(x) else np.zeros((0, len(model["mean"])))
        return pd.Series((model["w"][0] + z @ model["w"][1:]).clip(-30, 30))

    return score(text)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, lower-case; null where it has none."""
    parts = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]+)", 1)
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    return F.nullif(F.lower(parts), F.lit("")), F.nullif(segment, F.lit(""))


def _strength(spread: float, groups: int, rows: float, mean: float) -> float:
    """Pseudo-documents of a prior, from the spread of group rates around it.

    ``spread``: the sum of squared deviations, weighted by rows; ``groups``: how many deviate freely.
    """
    within = mean * (1 - mean)
    between = (spread - within * groups) / max(rows, 1.0)
    return min(max(within / max(between, 1e-9) - 1, 1.0), 1e6)


def site_table(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n, good, host_n, host_good), and the global rate with both strengths.

    ``scored`` has host, path (both without nulls) and p, a document's probability.
    """
    sites = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    sites = written(sites.join(hosts, "host"), "sites")
    every = sites.agg(F.sum("n"), F.sum("good"), F.count(F.lit(1)), F.countDistinct("host")).first()
    rows, paths, n_hosts = float(every[0] or 0), every[2], every[3]
    mean = min(max((every[1] or 0.0) / max(rows, 1.0), 1e-3), 1 - 1e-3)
    of_host = F.col("host_good") / F.col("host_n")
    apart = sites.agg(
        F.sum(F.col("n") * F.pow(of_host - mean, F.lit(2.0))).alias("hosts"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - of_host, F.lit(2.0))).alias("paths")
    ).first()
    return sites, {
        "mean": mean,
        "hosts": _strength(apart["hosts"] or 0.0, max(n_hosts - 1, 0), rows, mean),
        "paths": _strength(apart["paths"] or 0.0, max(paths - n_hosts, 0), rows, mean),
    }


def prior_without(p: Column, site: Column, found: dict[str, float]) -> Column:
    """The posterior rate of a document's path from all documents but itself, whose probability is ``p``."""
    host = (site["host_good"] - p + found["hosts"] * found["mean"]) / (site["host_n"] - 1 + found["hosts"])
    return (site["good"] - p + found["paths"] * host) / (site["n"] - 1 + found["paths"])


def _share(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def classify(
    docs: DataFrame, labels: DataFrame, out: str, host: Column | str = "source", path: Column | str = "lang", text: Column | str = "text", rows: int = TRAIN_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: odds, the site's prior and the score (log odds; negative ones are rejected).

    ``labels`` are of ``docs``' column doc_id; its texts are ``text``.
    """
    column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    model = fit(docs.select("doc_id", column(text).alias("text")), labels, rows)
    key = lambda c: F.coalesce(column(c).cast("string"), F.lit("\0"))
    scored = F.struct(key(host).alias("host"), key(path).alias("path"), log_odds(column(text), model).alias("odds"))
    scored = written(docs.select(*(F.col(f"`{c}`") for c in keep or docs.columns), scored.alias(out)), "scored")
    mine = F.col(out)
    sites, found = site_table(scored.select(mine["host"].alias("host"), mine["path"].alias("path"), _share(mine["odds"]).alias("p")))
    site = unused("__site", scored)
    small = sites.count() <= BROADCAST_SITES
    sites = sites.select(F.struct(*sites.columns).alias(site))
    same = (mine["host"] == F.col(site)["host"]) & (mine["path"] == F.col(site)["path"])
    joined = scored.join(F.broadcast(sites) if small else sites, same, "left")
    prior = prior_without(_share(mine["odds"]), F.col(site), found)
    score = mine["odds"] - model["base"] + _logit(prior) if model else F.lit(0.0)
    return joined.withColumn(out, F.struct(mine["odds"].alias("odds"), prior.alias("prior"), score.alias("score"))).drop(site)


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id with the classifier's probability, the site's prior, the score and the verdict."""
    found = classify(docs, labels, "found", **options, keep=["doc_id"]).select("doc_id", "found.*")
    return found.select(
        "doc_id",
        _share(F.col("odds")).alias("classifier"),
        F.col("prior").alias("site_prior"),
        _share(F.col("score")).alias("score"),
        (_share(F.col("score")) >= KEEP).alias("kept"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    out = unused("__found", docs)
    return classify(docs, labels, out, **options).where(_share(F.col(out)["score"]) >= KEEP).drop(out)
