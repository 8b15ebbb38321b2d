"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Training documents are those whose CRC-32 of doc_id as text is not 2 modulo 7.
Their tokens (lower-cased words and an end) are counted by a distributed
aggregation over all of them. The most frequent ``HEAD`` tokens go to every
task; counts of all others reach the documents by a join.

Tokens have classes: the ``TOP`` most frequent one each, the rest of the head
one for each band of ``BAND`` tokens of like frequency (so classes grow with the
vocabulary), and one for all tokens beyond the head. The model is a product of
two log-bilinear factors. A token's class follows the classes before it:
``b[k] + (c1 * r[k1] + c2 * r[k2]) . q[k]``; a token of a band follows the class
before it: ``v[w] + s[k1] . u[w]`` among its band. Scoring normalises both
exactly, each context's sum is remembered. A token beyond the head has that
class's probability times its own among the rest, add-one smoothed with all
unseen words as one, so a text's tokens have a proper distribution; this last
part is unigram.

Training runs in ``ROUNDS``. Documents are dealt by hash of doc_id to rounds and
to shards of about ``SHARD`` tokens, which are sorted, so what a shard learns
hangs neither on partitions nor on tasks. In a round each shard trains a copy in
numpy over all its tokens, from the same start; copies are averaged, weighted
by tokens, by an aggregation over blocks of parameters, and the next round
starts from the average.

Defined results: a null text counts as empty (the end alone); a null doc_id
counts as training; repeated rows each get a row; an empty table gives an empty
table; without training documents every class is equally likely; further
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_bytes, written

#: Tokens whose counts and parameters every task holds, those with a class each, and those of a band.
HEAD = 65_536  # ranks fit 16 bits
TOP = 1000
BAND = 256
#: Numbers of each class's and of each word's vectors.
WIDTH, WORD_WIDTH = 24, 12
BATCH = 2048
#: Noise classes of a batch, and noise words of each token of a band.
NOISE, WORD_NOISE = 32, 2
RATE = 0.04
#: What Adagrad's sums start from: a rare row's first steps stay small.
FIRST = 0.1
ROUNDS = 2
#: Training tokens of a shard, and parameters of a block.
SHARD, BLOCK = 4_000_000, 4096
#: Shards whose copies are summed at once.
SUMMED = 64
#: The end of a text; no word holds a line's end.
END = b"\n"
#: Words after which a task's partial counts are passed on.
FLUSH = 250_000
#: Tokens scored at once.
TOGETHER = 1 << 18

_PARTS = ("r", "q", "c", "b", "s", "u", "v")


def held_out():
    """Whether a document is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``texts`` (text)."""

    def run(batches):
        import pyarrow as pa

        found: Counter = Counter()

        def flushed():
            keys = pa.array(list(found.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([keys, pa.array(list(found.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for t in text_bytes(b.column(0)):
                found.update(tokens(t))
            if len(found) >= FLUSH:
                yield flushed()
                found = Counter()
        if found:
            yield flushed()

    return texts.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


class _Ranks(dict):
    """Rank of a frequent token; -1 for any other."""

    def __missing__(self, token):
        return -1


class Model:
    """Parameters, and the counts that come with them."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.top, self.of_band = min(TOP, len(words)), BAND
        self.bands = -(-(len(words) - self.top) // self.of_band)
        self.classes = self.top + self.bands  # then the rest class, then the start
        rest = total - int(counts.sum())
        self.log_rest = np.log10(max(rest + distinct - len(words), 0) + 1)
        # Of each rank its class, and of each band its words: the last one may be short.
        self.class_at = np.append(np.minimum(np.arange(len(words)), self.top + (np.arange(len(words)) - self.top) // self.of_band), self.classes)
        sizes = np.bincount(self.class_at[:-1], weights=counts, minlength=self.classes)
        share = np.append(sizes, max(rest, 1)) + 1
        self.noise = share / share.sum()
        rng, n = np.random.default_rng(42), self.classes + 2
        random = lambda *shape: rng.normal(0, 0.1, shape).astype("f4")
        self.r, self.q, self.c = random(n, WIDTH), random(n - 1, WIDTH), np.ones((2, WIDTH), "f4")
        self.b = np.log(self.noise).astype("f4")
        self.s, self.u = random(n, WORD_WIDTH), random(len(words) - self.top, WORD_WIDTH)
        self.v = np.log((counts[self.top :] + 1) / np.maximum(sizes[self.class_at[self.top : -1]], 1)).astype("f4")
        self.key = uuid.uuid4().hex

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).reshape(-1) for p in _PARTS])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for p in _PARTS:
            shape = getattr(self, p).shape
            setattr(self, p, values[at : at + np.prod(shape, dtype=int)].reshape(shape).astype("f4"))
            at += int(np.prod(shape, dtype=int))
        self.key = uuid.uuid4().hex

    def band(self, k: int) -> slice:
        """The rows of band k's words in u and v."""
        return slice(k * self.of_band, min((k + 1) * self.of_band, len(self.v)))

    def class_of(self, ranks: np.ndarray) -> np.ndarray:
        return self.class_at[ranks]  # rank -1 is the last: the rest

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two before; ``first`` are the places where texts begin."""
        start = self.classes + 1
        one, two = np.roll(classes, 1), np.roll(classes, 2)
        one[first] = two[first] = start
        second = first[first + 1 < len(classes)] + 1
        two[second] = start
        return one, two


def _step(rows: np.ndarray, *tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """An Adagrad step for the rows that occur in ``rows``, in each of some tables (values, their sums, gradients)."""
    order = np.argsort(rows.astype("u2"), kind="stable")  # of 16 bits, which are sorted by counting
    rows = rows[order]
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rows = rows[at]
    for into, seen, grads in tables:
        g = np.add.reduceat(grads[order], at, axis=0)
        sums = seen[rows] + g * g
        seen[rows] = sums
        into[rows] += RATE * g / np.sqrt(sums)


def train_on(model: Model, one: np.ndarray, two: np.ndarray, target: np.ndarray, word: np.ndarray, seen: dict, rng) -> None:
    """One pass of noise-contrastive estimation over a run of tokens; ``word`` are ranks."""
    log_noise = np.log(NOISE * model.noise).astype("f4")
    cumulated = np.cumsum(model.noise)
    sizes = np.minimum(model.of_band, len(model.v) - np.arange(max(model.bands, 1)) * model.of_band)
    for at in range(0, len(target), BATCH):
        w1, w2, w = one[at : at + BATCH], two[at : at + BATCH], target[at : at + BATCH]
        noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(cumulated) - 1)
        r1, r2 = model.r[w1], model.r[w2]
        h = model.c[0] * r1 + model.c[1] * r2
        of = model.q[w]
        score = (h * of).sum(axis=1) + model.b[w] - log_noise[w]
        up = 1 / (1 + np.exp(score.clip(-30, 30)))  # data: 1 - sigmoid
        other = h @ model.q[noise].T + model.b[noise] - log_noise[noise]
        down = -1 / (1 + np.exp(-other.clip(-30, 30)))  # noise: -sigmoid
        gh = up[:, None] * of + down @ model.q[noise]
        of_classes = np.vstack([up[:, None] * h, down.T @ h]), np.r_[up, down.sum(axis=0)]
        _step(np.r_[w, noise], (model.q, seen["q"], of_classes[0]), (model.b, seen["b"], of_classes[1]))
        _step(np.r_[w1, w2], (model.r, seen["r"], np.vstack([gh * model.c[0], gh * model.c[1]])))
        gc = np.vstack([(gh * r1).sum(axis=0), (gh * r2).sum(axis=0)])
        seen["c"] += gc * gc
        model.c += RATE * gc / np.sqrt(seen["c"])

        # Words within their bands, against words drawn evenly from the same band.
        inside = np.flatnonzero((w >= model.top) & (w < model.classes))
        if not len(inside):
            continue
        band, k1 = w[inside] - model.top, w1[inside]
        x = word[at : at + BATCH][inside] - model.top
        size = sizes[band]
        drawn = band[:, None] * model.of_band + (rng.random((len(x), WORD_NOISE)) * size[:, None]).astype(np.intp)
        every = np.concatenate([x[:, None], drawn], axis=1)
        h, of = model.s[k1], model.u[every]
        score = np.einsum("nw,njw->nj", h, of) + model.v[every] - np.log(WORD_NOISE / size)[:, None].astype("f4")
        grad = -1 / (1 + np.exp(-score.clip(-30, 30)))
        grad[:, 0] += 1
        of_words = (grad[:, :, None] * h[:, None, :]).reshape(len(x) * (WORD_NOISE + 1), -1), grad.reshape(-1)
        _step(every.reshape(-1), (model.u, seen["u"], of_words[0]), (model.v, seen["v"], of_words[1]))
        _step(k1, (model.s, seen["s"], np.einsum("nj,njw->nw", grad, of)))


def _ranked(texts: list[bytes], ranks: _Ranks) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Tokens of each text, all their ranks in a row, and where texts begin."""
    words = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, words), "i8", len(words))
    flat = np.fromiter((k for ws in words for k in map(ranks.__getitem__, ws)), "i8", int(sizes.sum()))
    return words, flat, np.cumsum(sizes) - sizes


def together(texts: list[bytes]):
    """(first, last) of runs of texts of about ``TOGETHER`` tokens."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= TOGETHER:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _averaged(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The mean of copies (shard, k, n, v), blocks v of parameters, weighted by n; summed in order of shards."""

    def summed(table):
        import pyarrow as pa

        order = np.argsort(np.asarray(table.column("shard")))
        n = np.asarray(table.column("n"))[order]
        v = np.asarray(table.column("v").combine_chunks().flatten(), "f8").reshape(len(n), -1)[order]
        total = (v * n[:, None]).sum(axis=0) / n.sum()
        first = [np.asarray(table.column(c))[order[:1]] for c in ("shard", "k")]
        return pa.table({"shard": first[0], "k": first[1], "n": [n.sum()], "v": pa.array([total.astype("f4")], pa.list_(pa.float32()))})

    schema = "shard long, k long, n double, v array<float>"
    if shards > SUMMED:
        copies = copies.groupBy("k", F.floor(F.col("shard") / SUMMED)).applyInArrow(summed, schema)
    found = copies.groupBy("k").applyInArrow(summed, schema).toArrow()
    if not found.num_rows:
        return None
    parts = dict(zip(found.column("k").to_pylist(), found.column("v").combine_chunks(), strict=True))
    return np.concatenate([np.asarray(parts[k].values) for k in range(len(parts))])


def train(docs: DataFrame, model: Model) -> Model:
    """Trains copies on the shards of ``docs`` (doc_id, text) and averages them, round by round."""
    shards = max(1, -(-model.total // SHARD))
    key = F.xxhash64(F.lit("lm"), F.col("doc_id"))
    dealt = docs.select(F.pmod(key, F.lit(ROUNDS)).alias("round"), F.pmod(F.floor(key / ROUNDS), F.lit(shards)).alias("shard"), "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        ranks = _Ranks((w, k) for k, w in enumerate(model.words))
        start, now, n, rng, seen = model.flat(), None, 0, None, {}

        def copy():
            values = model.flat()
            blocks = [values[at : at + BLOCK] for at in range(0, len(values), BLOCK)]
            k = len(blocks)
            columns = [pa.array([now] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array([float(n)] * k), pa.array(blocks, pa.list_(pa.float32()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "k", "n", "v"])

        for b in batches:
            data, of = text_bytes(b.column(1)), np.asarray(b.column(0))
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                if of[lo] != now:
                    if now is not None:
                        yield copy()
                    now, n, rng = int(of[lo]), 0, np.random.default_rng(int(of[lo]))
                    model.set_flat(start.copy())
                    seen = {p: np.full_like(getattr(model, p), FIRST) for p in _PARTS}
                for i, j in together(data[lo:hi]):
                    _, flat, first = _ranked(data[lo + i : lo + j], ranks)
                    classes = model.class_of(flat)
                    train_on(model, *model.contexts(classes, first), classes, flat, seen, rng)
                    n += len(classes)
        if now is not None:
            yield copy()

    for r in range(ROUNDS):
        # A shard's texts come in one order whatever the partitions: runs of equal ids are ordered by their texts.
        mine = dealt.where(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text")
        values = _averaged(mine.select("shard", "text").mapInArrow(run, "shard long, k long, n double, v array<float>"), shards)
        if values is not None:
            model.set_flat(values)
    return model


_SUMS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _log_sums(score: np.ndarray) -> np.ndarray:
    top = score.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(score - top).sum(axis=1, dtype="f8"))


def log_probabilities(model: Model, ranks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token after those before it; of one beyond the head, that of its class."""
    size = model.classes + 2
    if model.key not in _SUMS:
        _SUMS.clear()
        _SUMS[model.key] = np.full(size * size, np.nan), np.full(size * max(model.bands, 1), np.nan)
    sums, in_band = _SUMS[model.key]
    classes = model.class_of(ranks)
    one, two = model.contexts(classes, first)
    r1, r2 = model.c[0] * model.r, model.c[1] * model.r
    context = one * size + two
    new = np.unique(context)
    new = new[np.isnan(sums[new])]
    q = model.q.T
    for at in range(0, len(new), 1024):
        k = new[at : at + 1024]
        sums[k] = _log_sums((r1[k // size] + r2[k % size]) @ q + model.b)
    out = np.einsum("ij,ij->i", r1[one] + r2[two], model.q[classes]) + model.b[classes] - sums[context]

    inside = np.flatnonzero((classes >= model.top) & (classes < model.classes))
    context = (classes[inside] - model.top) * size + one[inside]  # by band, so that a band's contexts are together
    new = np.unique(context)
    new = new[np.isnan(in_band[new])]
    band = new // size
    for k in np.unique(band).tolist():
        mine = new[np.searchsorted(band, k) : np.searchsorted(band, k, "right")]
        words = model.band(k)
        in_band[mine] = _log_sums(model.s[mine % size] @ model.u[words].T + model.v[words])
    x = ranks[inside] - model.top
    out[inside] += np.einsum("ij,ij->i", model.s[one[inside]], model.u[x]) + model.v[x] - in_band[context]
    return out


_SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_tail long, "
    "tail array<struct<token: string, n: int>>"
)


def _score_all(docs: DataFrame, model: Model) -> DataFrame:
    """Sums over the frequent tokens of each document, and its other tokens with their counts."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ranks = _Ranks((w, k) for k, w in enumerate(model.words))
        row = TaskContext.get().partitionId() << 36
        log_c = np.append(np.log10(model.counts + 1.0), 0.0)  # rank -1: the rest's counts come later
        smooth = np.log10(model.total + model.distinct + 1)
        kind = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32())]))
        names = [c.split()[0] for c in _SCORED.split(", ")[:8]] + ["tail"]
        for b in batches:
            data = text_bytes(b.column(2))
            for i, j in together(data):
                words, flat, first = _ranked(data[i:j], ranks)
                sizes = np.diff(np.r_[first, len(flat)])
                logs = log_probabilities(model, flat, first) / np.log(10)
                logs -= np.where(flat < 0, model.log_rest, 0.0)  # the rest's counts come later
                tails = []
                at = np.flatnonzero(flat < 0)
                for lo, hi, f, ws in zip(np.searchsorted(at, first), np.searchsorted(at, first + sizes), first.tolist(), words, strict=True):
                    found = Counter(ws[k - f] for k in at[lo:hi].tolist())
                    tails.append([{"token": w.decode(), "n": n} for w, n in found.items()])
                arrays = [
                    pa.array(np.arange(row, row + j - i)), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes),
                    pa.array(np.add.reduceat(flat >= 0, first, dtype="i8")),
                    pa.array(np.add.reduceat(log_c[flat], first) - smooth * sizes), pa.array(np.add.reduceat(logs, first)),
                    pa.array(np.add.reduceat(flat < 0, first, dtype="i8")), pa.array(tails, kind),
                ]
                row += j - i
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, _SCORED)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training documents of ``docs``, and all their counts (token, c)."""
    own = docs.where(~held_out()).select(F.col("doc_id").cast("long"), "text")
    counts = written(count_tokens(own.select("text")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    words = [w.encode() for w in head.column("token").to_pylist()]
    if END not in words[:TOP]:  # the end has a class of its own, or there are no texts
        c = dict(zip(words, head.column("c").to_pylist(), strict=True)).get(END)
        if c is None and words:
            c = counts.where(F.col("token") == END.decode()).first()[1]
        values = [x for x in zip(words, head.column("c").to_pylist(), strict=True) if x[0] != END]
        values.insert(0, (END, c or 0))
        words, head_counts = [x[0] for x in values], np.array([x[1] for x in values], "i8")
    else:
        head_counts = np.asarray(head.column("c"), "i8")
    return train(own, Model(words, head_counts, int(total), int(distinct))), counts


def score(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of each row of ``docs`` (doc_id, text), under add-one counts and the model."""
    model, counts = fit(docs)
    scored = written(_score_all(docs, model), "scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n")
    found = tail.join(counts, "token").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log_c"), F.sum("n").alias("known")
    )
    out = scored.drop("tail").join(found, "row", "left")
    log_c, known = F.coalesce("log_c", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"),
        (F.col("score") + log_c).alias("score"),
    )
