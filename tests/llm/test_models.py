"""Language model, embeddings, quotations and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import embedding_dedup, lm, quotes
from lodestone.llm.components import connected_components

WORD = r"[^\x20\x09-\x0D]+"


def tokens(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, sf_dir, odd_docs, no_docs):
    big = sf_dir.replace("0.001", "0.01")
    for df in (spark.read.parquet(f"{big}/documents.parquet"), odd_docs):
        docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
        n, v = c.total(), len(c)
        want = Counter()
        for d, t in docs:
            w = tokens(t)
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
            want[d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
        rows = lm.score(df).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
        if len(docs) > 100:
            unseen = [r for r in rows if r["held_out"]]
            assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert lm.score(no_docs).count() == 0


def small_model(monkeypatch):
    monkeypatch.setattr(lm, "TOP", 12)
    monkeypatch.setattr(lm, "BAND", 7)
    words = [lm.END, *(f"w{k}".encode() for k in range(30))]
    model = lm.Model(words, np.arange(40, 9, -1), 2000, 100)
    rng = np.random.default_rng(0)
    for p in ("q", "r", "s", "u", "v"):
        setattr(model, p, rng.normal(0, 1, getattr(model, p).shape).astype("f4"))
    return model


def test_probabilities_of_words_sum_to_one(monkeypatch):
    model = small_model(monkeypatch)
    assert (model.top, model.bands, model.classes) == (12, 3, 15)
    for a, b in ((0, 1), (5, 5), (-1, 3), (30, 14), (13, -1)):
        p = [math.exp(lm.log_probabilities(model, np.array([a, b, k]), np.array([0]))[2]) for k in range(-1, len(model.words))]
        assert abs(sum(p) - 1) < 1e-5 and min(p) > 0


def slow_score(model, counts, text):
    """log10 probability of a text, token by token, each sum made anew in double precision."""
    rank = {w.decode(): k for k, w in enumerate(model.words)}
    f8 = {p: np.asarray(getattr(model, p), "f8") for p in lm._PARTS}
    k1 = k2 = model.classes + 1
    total = 0.0
    for t in tokens(text):
        t = "\n" if t is None else t
        k = rank.get(t, -1)
        c = model.classes if k < 0 else k if k < model.top else model.top + (k - model.top) // lm.BAND
        score = (f8["c"][0] * f8["r"][k1] + f8["c"][1] * f8["r"][k2]) @ f8["q"].T + f8["b"]
        total += score[c] - np.log(np.exp(score).sum())
        if model.top <= c < model.classes:
            words = range((c - model.top) * lm.BAND, min((c - model.top + 1) * lm.BAND, len(model.words) - model.top))
            score = {w: f8["s"][k1] @ f8["u"][w] + f8["v"][w] for w in words}
            total += score[k - model.top] - np.log(sum(map(np.exp, score.values())))
        if k < 0:
            total += np.log(counts[t] + 1) - model.log_rest * np.log(10)
        k1, k2 = c, k1
    return total / np.log(10)


def test_scores_equal_a_slow_computation_and_do_not_hang_on_partitions(spark, sf_dir, monkeypatch):
    for name, value in (("HEAD", 900), ("TOP", 100), ("BAND", 64), ("SHARD", 20_000)):
        monkeypatch.setattr(lm, name, value)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = lm.fit(docs)
    counts = Counter({r["token"]: r["c"] for r in counts.collect()})
    assert model.total > 3 * lm.SHARD and model.bands == 13
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(7)).collect()}
    again = {r["doc_id"]: r["score"] for r in lm.score(docs.coalesce(1)).collect()}
    for d in sorted(texts)[:60]:
        want = slow_score(model, counts, texts[d])
        assert abs(got[d] - want) < 1e-4 * abs(want)
    assert all(abs(got[d] - again[d]) < 1e-6 * abs(got[d]) for d in texts)


def test_the_model_learns_what_follows(monkeypatch):
    """Pairs of rare words that always go together: the class factor cannot tell words of a band apart."""
    monkeypatch.setattr(lm, "TOP", 10)
    monkeypatch.setattr(lm, "BAND", 8)
    rng = np.random.default_rng(3)
    words = [lm.END, *(f"w{k}".encode() for k in range(40))]
    model = lm.Model(words, np.full(41, 100), 4100, 41)
    # Word 1 is followed by 20, 2 by 21, 3 by 22: all of the same band.
    ranks = np.array([x for _ in range(60_000) for k in [rng.integers(1, 4)] for x in (k, 19 + k)])
    first = np.arange(0, len(ranks), 2)
    classes = model.class_of(ranks)
    seen = {p: np.full_like(getattr(model, p), lm.FIRST) for p in lm._PARTS}
    lm.train_on(model, *model.contexts(classes, first), classes, ranks, seen, rng)
    p = lambda a, b: math.exp(lm.log_probabilities(model, np.array([a, b]), np.array([0]))[1])
    assert all(p(k, 19 + k) > 0.5 for k in (1, 2, 3)) and p(1, 21) < 0.1


def links_of(vectors, least=0.95):
    x = np.array(vectors, float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def slow_labels(near, ids):
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    v = np.vstack([base, base[:60] + rng.normal(0, 0.04, (60, 32)), np.repeat(base[:1], 40, axis=0), base[:1] + rng.normal(0, 0.03, (80, 32))]).astype("f4")
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    near = links_of(v)
    label = slow_labels(near, range(len(v)))
    for per_cell in (512, 40):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, per_cell=per_cell).collect()}
        assert len(got) == len(v)
        assert [got[i]["n_links"] for i in range(len(v))] == near.sum(axis=1).tolist()
        assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.dedup(df).count() == len(set(label))


def test_vectors_of_extreme_norms_or_without_one(spark):
    tiny = 5e-324  # the least number above zero
    rows = [
        (1, [1e-200, 0.0]), (2, [1e200, 1e190]), (3, [3e-200, 1e-203]), (4, [0.0, tiny]), (5, [0.0, 1e308]), (6, [0.0, 0.0]), (7, None), (8, []),
        (9, [1.0, None]), (10, [1.0, float("nan")]), (11, [float("inf"), 1.0]), (12, [1.0]), (13, [2.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (14, [1.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "vec_id long, embedding array<double>, kept_id string, v double")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), *((k, 0, k, True) for k in (6, 7, 8, 9, 10, 11))]
    want += [(12, 1, 12, True), (13, 1, 12, False), (14, 2, 14, True), *[(None, 2, 14, False)] * 2]
    assert got == Counter(want)
    kept = embedding_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["vec_id"] for r in kept.collect()) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 14]
    none = df.limit(0)
    assert embedding_dedup.near_duplicates(none).count() == embedding_dedup.dedup(none).count() == 0


def test_a_common_direction_asks_few_cells(spark):
    """Vectors that share most of their length, as text embeddings do: all links, and far from all cells."""
    rng = np.random.default_rng(11)
    topics = rng.normal(size=(40, 64)) * 0.12
    x = rng.normal(size=64) / 8 * 3 + topics[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 0.02
    x[:500] = rng.normal(size=64)  # a sixth are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = links_of(x, 0.995)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, cosine=0.995, per_cell=75).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(axis=1).tolist()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    centroids = embedding_dedup.spherical_kmeans(unit, 40)
    similar = unit @ centroids.T
    asked = similar >= similar.max(axis=1, keepdims=True) - embedding_dedup.margins(centroids, similar.argmax(axis=1), 0.995)
    assert asked.sum(axis=1).mean() < 8


def test_no_link_across_cells_is_lost(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x, y = unit(rng.normal(size=(1500, 8))), rng.normal(size=(1500, 8))
    y = unit(y - (y * x).sum(axis=1)[:, None] * x)
    v = np.vstack([x, 0.951 * x + math.sqrt(1 - 0.951**2) * y]) @ np.linalg.qr(rng.normal(size=(32, 8)))[0].T
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    near = links_of(v)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, per_cell=375).collect()}
    assert [got[i]["n_links"] for i in range(len(v))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(v))] == slow_labels(near, range(len(v))).tolist()


def test_odd_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    rows += [(6, [1.0, 2.0]), (7, [2.0, 4.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter({**{(k, 0, k): 1 for k in range(6)}, (6, 3, 6): 1, (7, 3, 6): 2, (None, 3, 6): 1, (8, 0, 8): 1})
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (103, 103), (None, 5), (200, 50)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 200: 0, 100: 100, 101: 100}


def test_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond part."), (1, 1, "assistant", "fine"), (1, 2, "user", "> Hello there.\n> How are you?\nI am well\n> > deep"),
        (1, 3, "x", "On Monday A wrote:\n> i am   WELL\n\nreply"), (2, 0, "user", "> fine\nother"), (2, 1, None, None), (None, None, "u", "q"), (2, 1, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.format_chat(df)
    one = [(r["turn"], r["parent_turn"], r["n_quotes"], r["n_linked"]) for r in got.where("conv_id = 1").orderBy("position").collect()]
    assert one == [(0, None, 0, 0), (2, 0, 2, 1), (3, 2, 1, 1), (1, None, 0, 0)]
    assert got.where("conv_id = 2 AND turn = 0").first()["n_linked"] == 1
    assert got.count() == len(rows)
    assert not got.where("conv_id = 1 AND text LIKE '%> Hello%'").count()
    texts = {r["conv_id"]: r["text"] for r in quotes.conversations(got).collect()}
    assert texts[1].startswith("<|user|>\nHello there.") and texts[1].endswith("<|assistant|>\nfine<|end|>\n")
    assert quotes.format_chat(df.limit(0)).count() == 0


def test_interleaved_trimmed_and_far_quotes_link(spark):
    rows = [
        (1, 0, "a", "q"), (1, 1, "b", "a1\n\n> q\na2"), (1, 2, "a", "> a1\n> > q\n> a2\nyes"), (1, 3, "b", "line one\nline two\nline three"),
        (1, 4, "a", "> line two\n> line three\nagreed"), (1, 5, "b", "> line two\n> line four\nwhat"), (1, 6, "a", "> said elsewhere\nno"),
        (1, 7, "b", "said elsewhere"), (2, 0, "a", "said elsewhere"),
    ]
    got = quotes.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1")
    found = {r["turn"]: (r["parent_turn"], r["n_quotes"], r["n_linked"]) for r in got.collect()}
    assert found == {0: (None, 0, 0), 1: (0, 1, 1), 2: (1, 3, 3), 3: (None, 0, 0), 4: (3, 1, 1), 5: (None, 1, 0), 6: (None, 1, 1), 7: (None, 0, 0)}
    assert got.where("turn = 1").first()["text"] == "<|b|>\na1\n\na2<|end|>\n"


def test_conversations_without_quotes_keep_their_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = quotes.format_chat(df)
    assert got.where("position <> turn").count() == 0 and got.count() == df.count()


def test_levels_and_passages():
    assert quotes.levels("> > a\n>b\nc") == [(2, "a"), (1, "b"), (0, "c")]
    assert quotes.passages(["a", "", "b"]) == [["a", "", "b"], ["a"], ["b"]]
    assert quotes.passage_hash([" A  b"]) == quotes.passage_hash(["a", "B"])

def test_scratch_tables_can_be_discarded(spark, odd_docs):
    from pathlib import Path

    from lodestone.llm import common

    path = common.written(odd_docs, "t").inputFiles()[0].removeprefix("file://")
    assert Path(path).exists()
    kept, common._SCRATCH[:] = common._SCRATCH[:-1], common._SCRATCH[-1:]
    common.discard(spark)
    common._SCRATCH[:] = kept
    assert not Path(path).exists()
