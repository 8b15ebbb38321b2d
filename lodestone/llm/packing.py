"""Sequence packing: bounded-space online best fit.

Each partition of the input keeps a fixed number of open windows. A document's
ids (with its end id) are cut into full windows and a rest; the rest goes into
the open window that it leaves with the least room. If none has room for it,
the fullest window is topped up with the start of the rest, when at least
``min_piece`` ids fit, and emitted, and the rest is placed again. What is open
when a partition ends is merged in a second step: leftovers are dealt to
groups, each concatenates its own, cuts full windows and splits what then
remains by powers of two, which need no padding.

One task holds a partition's open windows only: ``open_windows * width`` ids at
most, whatever the input. Groups of the second step hold the leftovers of about
``GROUPED`` partitions.

Defined results: a null text counts as empty, and an empty text is the end id
alone; repeated rows are packed as often as they occur; pieces of rows that share
a doc_id carry that id alike; an empty table gives an empty table; further
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.wordids import crc_of, vocabulary, word_ids

WIDTH = 2048
END_ID = 1
OPEN_WINDOWS = 64
MIN_PIECE = 16
#: Bytes of texts whose ids are made together.
CHUNK = 3 << 20
#: Partitions whose leftovers one group of the second step merges.
GROUPED = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIRST = f"{PIECES}, grp long, ids binary"


class Packer:
    """Open windows of one partition. A piece is (document, start, ids, document's ids)."""

    def __init__(self, width: int, windows: int, min_piece: int):
        self.width, self.most, self.min_piece = width, windows, min_piece
        self.open: dict[int, list] = {}
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0

    def _put(self, window: int, room: int, piece: tuple) -> list | None:
        doc, start, ids, total = piece
        self.open.setdefault(window, []).append((doc, start, ids.copy(), total))  # a copy, not a view of a whole chunk
        room -= len(ids)
        if room:
            insort(self.room, (room, window))
            return None
        return self.open.pop(window)

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """Places a document; yields the windows that are full or closed."""
        total, at = len(ids), 0
        while total - at >= self.width:
            yield [(doc, at, ids[at : at + self.width], total)]
            at += self.width
        while at < total:
            need = total - at
            k = bisect_left(self.room, (need, -1))
            if k < len(self.room):  # the least room that it fits
                room, window = self.room.pop(k)
                full = self._put(window, room, (doc, at, ids[at:], total))
                at = total
            elif len(self.room) < self.most:
                self.made += 1
                full = self._put(self.made, self.width, (doc, at, ids[at:], total))
                at = total
            else:  # none fits: the fullest goes
                room, window = self.room.pop(0)
                if room >= self.min_piece:
                    full = self._put(window, room, (doc, at, ids[at : at + room], total))
                    at += room
                else:
                    full = self.open.pop(window)
            if full:
                yield full

    def rest(self) -> list[list]:
        return [self.open[w] for _, w in self.room]


def _cut(pieces: list[tuple], width: int) -> Iterator[list]:
    """Concatenates pieces and cuts full windows; the last ones are powers of two."""
    left = sum(len(p[2]) for p in pieces)
    sizes = [width] * (left // width)
    sizes += [1 << b for b in range(width.bit_length() - 1, -1, -1) if (left % width) >> b & 1]
    window, need = [], iter(sizes)
    room = next(need, 0)
    for doc, start, ids, total in pieces:
        while len(ids):
            part = ids[:room]
            window.append((doc, start, part, total))
            start, ids, room = start + len(part), ids[len(part) :], room - len(part)
            if not room:
                yield window
                window, room = [], next(need, 0)


def _rows(window: list, sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, total in window:
        out.append((doc, start, len(ids), crc_of(ids), total, sequence, offset))
        offset += len(ids)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    width: int = WIDTH,
    open_windows: int = OPEN_WINDOWS,
    min_piece: int = MIN_PIECE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece of a document of ``docs`` (doc_id, text), see ``PIECES``.

    A sequence's pieces lie gapless from offset 0. Sequence ids are unique;
    those of the second step are negative.
    """
    path = tokenizer or vocabulary()

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        each = word_ids(path).each
        part = TaskContext.get().partitionId()
        packer, n = Packer(width, open_windows, min_piece), part << 36
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch(rows, grp=None, ids=None):
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays += [pa.array([grp] * len(rows), pa.int64()), pa.array(ids or [None] * len(rows), pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "grp", "ids"])

        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), each(b.column(1), end_id, CHUNK), strict=True):
                for window in packer.add(doc, ids):
                    rows += _rows(window, n)
                    n += 1
            yield batch(rows)
        left = [p for window in packer.rest() for p in window]
        yield batch(
            [(d, s, len(i), 0, t, part, k) for k, (d, s, i, t) in enumerate(left)],
            part // GROUPED,
            [np.ascontiguousarray(i, "<u4").tobytes() for _, _, i, _ in left],
        )

    def second(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["sequence_id", "offset"])
        pieces = [
            (r.doc_id, r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens)
            for r in pdf.itertuples(index=False)
        ]
        n = -1 - (int(key[0]) << 36)
        rows = []
        for window in _cut(pieces, width):
            rows += _rows(window, n)
            n -= 1
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({c: "int64" for c in out.columns if c != "doc_id"}).astype({"doc_id": "Int64"})

    out = written(docs.select("doc_id", "text").mapInArrow(first, _FIRST), "pieces")
    done = out.where("ids IS NULL").select(*(c.split()[0] for c in PIECES.split(", ")))
    left = out.where("ids IS NOT NULL").groupBy("grp").applyInPandas(second, PIECES)
    return done.unionByName(left)


def padding(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Totals of a packing: sequences, ids and padding (none at a power of two)."""
    n = F.sum("length")
    by = pieces.groupBy("sequence_id").agg(n.alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return by.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("ids"),
        F.sum(F.when(power, 0).otherwise(width - F.col("n"))).alias("padding"),
    )
