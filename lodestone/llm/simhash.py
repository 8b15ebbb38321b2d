"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set when over half of its 4-word shingles'
hashes have it. Documents link when their fingerprints differ in at most
``RADIUS`` bits. Candidates are exact: the 64 bits are cut into 6 bands, and
fingerprints within 4 bits agree on at least 2 of them, so every linked pair
meets in one of the 15 tables keyed by two bands. Equal fingerprints are one
row there, so copies cost nothing.

Fingerprints of a bucket are stored as bit planes, 64 of them to a machine
word. A query's distances to a word's 64 fingerprints are counted at once by
carry-save bitwise counters, plane by plane; words whose every fingerprint is
beyond the radius are abandoned. A bucket of over ``BLOCK`` fingerprints is cut
into blocks, and each pair of blocks is a task's work of its own. Found pairs
are never listed: each task joins them to groups and returns a link from each
member to its group's least one.

Defined results: a null or empty text, or one of separators only, has the
fingerprint zero and links as any other; fewer than four words are one
shingle; repeated rows each get a row; an empty table gives an empty table. A
component of null ids alone has a null id. Further columns are ignored by
``near_duplicates`` and kept by ``dedup``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_bytes, unused, written
from lodestone.llm.components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
BANDS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a bucket that one task compares with each other.
BLOCK = 16384
#: (fingerprint, word) cells compared at once.
CELLS = 1 << 19


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each shingle of a text, as unsigned 64-bit integers."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, "u8")
    whole = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], "u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "u8", n)


def fingerprint(text: bytes) -> int:
    """A bit is set if it is in over half of the shingles' hashes."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    totals = np.zeros(64, "i8")
    for at in range(0, len(h), 1 << 14):
        part = np.ascontiguousarray(h[at : at + (1 << 14)], ">u8")
        totals += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * totals > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(b.column(1))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def band_keys() -> list:
    """For each pair of bands, the column of table number and the two bands' bits."""
    at = np.cumsum([0, *BANDS]).tolist()
    bits = lambda i: F.shiftrightunsigned("fp", at[i]).bitwiseAND((1 << BANDS[i]) - 1)
    return [
        F.lit(t << 22) + F.shiftleft(bits(i), BANDS[j]) + bits(j)
        for t, (i, j) in enumerate(combinations(range(len(BANDS)), 2))
    ]


class Groups:
    """Disjoint sets over 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def near_pairs(fps: np.ndarray, group: np.ndarray, side: np.ndarray):
    """Yields arrays (i, j) of pairs of the same group that differ in at most 4 bits.

    ``fps`` are sorted by group and side. In a group with both sides, rows of
    side 0 are compared with those of side 1 only.
    """
    n = len(fps)
    if not n:
        return
    new = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
    run_of = np.cumsum(new) - 1  # a run: one side of one group
    run_at = np.flatnonzero(new)
    run_len = np.diff(np.r_[run_at, n])
    run_words = -(-run_len // 64)
    run_word_at = np.cumsum(run_words) - run_words
    inside = np.arange(n) - run_at[run_of]
    word_of, lane = run_word_at[run_of] + inside // 64, (inside % 64).astype("u8")
    word_at = np.flatnonzero(lane == 0)
    one = np.uint64(1)
    lanes = np.bitwise_or.reduceat(one << lane, word_at)
    planes = [np.bitwise_or.reduceat(((fps >> np.uint64(k)) & one) << lane, word_at) for k in range(64)]
    # The run that a row is compared with: its own, or side 1 of its group for a row of side 0.
    g, s = group[run_at], side[run_at]
    other = np.arange(len(run_at))
    other[:-1][(g[:-1] == g[1:]) & (s[:-1] != s[1:])] += 1
    paired = np.r_[False, other[:-1] != np.arange(len(run_at) - 1)] if len(run_at) > 1 else np.zeros(1, bool)
    compared = other[run_of]
    first_word = np.where(compared == run_of, word_of, run_word_at[compared])
    last_word = run_word_at[compared] + run_words[compared]
    cells = np.where(paired[run_of], 0, last_word - first_word)
    upto = np.cumsum(cells)
    row = 0
    while row < n:
        done = upto[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(upto, done + CELLS, "right")))
        some = np.repeat(np.arange(row, stop), cells[row:stop])
        if len(some):
            word = first_word[some] + np.arange(len(some)) - np.repeat(upto[row:stop] - cells[row:stop] - done, cells[row:stop])
            yield from _compare(fps, planes, lanes, some, word, word_at)
        row = stop


def _compare(fps, planes, lanes, row, word, word_at):
    zero = np.zeros(len(row), "u8")
    ones, twos, fours, beyond = zero, zero, zero, ~lanes[word]
    query = fps[row]
    full = ~np.uint64(0)
    for k in range(64):
        differ = planes[k][word] ^ (np.uint64(0) - ((query >> np.uint64(k)) & np.uint64(1)))
        carry = ones & differ
        ones = ones ^ differ
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        beyond = beyond | carry
        if k % 8 == 7 or k > 12:  # abandon the words that are beyond the radius throughout
            far = beyond | (fours & (ones | twos))
            left = far != full
            if not left.all():
                row, word, query = row[left], word[left], query[left]
                ones, twos, fours, beyond = ones[left], twos[left], fours[left], far[left]
                if not len(row):
                    return
    near = (~(beyond | (fours & (ones | twos)))).astype("<u8")
    for at in range(0, len(near), 1 << 14):  # in parts: a group of copies may hold many pairs
        part = near[at : at + (1 << 14)].view("u1").reshape(-1, 8)
        cell, lane = np.nonzero(np.unpackbits(part, axis=1, bitorder="little"))
        i, j = row[at + cell], word_at[word[at + cell]] + lane
        yield i[i != j], j[i != j]


def _linked(batches):
    """Rows (k, i, j, side, fp) sorted by all but fp -> links (a, b) of each group."""
    import pyarrow as pa

    def links(rows):
        k, i, j, side, fps = rows
        new = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        group, side, fps = group[several], side[several], fps[several]
        sets = Groups(len(fps))
        for a, b in near_pairs(fps.view("u8"), group, side):
            sets.join(a, b)
        moved = np.flatnonzero(sets.of != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[sets.of[moved]])], names=["a", "b"])

    kept = None
    for b in batches:
        rows = [np.asarray(c) for c in b.columns]
        if kept is not None:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        k, i, j = rows[:3]
        if not len(k):
            continue
        same = (k == k[-1]) & (i == i[-1]) & (j == j[-1])
        at = len(k) - int(np.argmin(same[::-1])) if not same.all() else 0
        if at:
            yield links([x[:at] for x in rows])
        kept = [x[at:] for x in rows]
    if kept is not None:
        yield links(kept)


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius."""
    keyed = fps.select("fp", F.explode(F.array(*band_keys())).alias("k"))
    large = keyed.groupBy("k").count().where(F.col("count") > block)
    large = large.select("k", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = keyed.join(large, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "k",
        F.least("own", "o").alias("i"),
        F.greatest("own", "o").alias("j"),
        (F.col("own") > F.col("o")).cast("int").alias("side"),
        "fp",
    )
    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "side").mapInArrow(_linked, "a long, b long")


def _roots(distinct: DataFrame) -> DataFrame:
    """``distinct``, a row for each fingerprint ``fp``, with the ``root`` of its component."""
    found = connected_components(fingerprint_links(distinct.select("fp")))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return member.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    every = written(fingerprints(docs), "fingerprints")
    member = _roots(written(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"))
    by_root = member.groupBy("root").agg(F.min("least").alias("component_id"))
    component = member.join(by_root, "root").select("fp", "component_id")
    return every.join(component, "fp").select("doc_id", "fp", "component_id")


def _fingerprints_of(texts):
    import pandas as pd

    return pd.Series(np.array([fingerprint((t or "").encode()) for t in texts], "u8").view("i8"))


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs`` stays: the one with the least doc_id, null being the last.

    Rows are told apart by a key that is written with them, so doc_id may be
    null or repeated: rows leave only for another of their own component.
    """
    fp = F.pandas_udf(_fingerprints_of, "long")("text")
    print_, row = unused("__fp", docs), unused("__row", docs)
    every = written(docs.withColumns({print_: fp, row: F.monotonically_increasing_id()}), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(print_).alias("fp"), F.col(row).alias("row")))
    member = _roots(written(every.groupBy(F.col(print_).alias("fp")).agg(first.alias("first")), "distinct"))
    keep = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    keep = written(keep, "keep").hint("shuffle_hash")  # the side that a semi join can hash, so that texts are not sorted
    return every.join(keep, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
