"""Token-id files: documents' ids in ascending doc_id order, coded in blocks.

Documents are dealt to tasks by range of doc_id and sorted there; a task codes
its ids segment by segment (see ``range_coder``) and Spark's text sink writes the
segments' bytes as they are, one file a task. So files go through Hadoop's file
systems and Spark's commit: a task that is run again after an executor is lost
leaves no second file. Reading needs the files only and checks every block's
checksum.

A file is segments, each followed by a line's end. A segment is: magic, numbers
of bytes, documents and ids, doc_ids with a null flag, lengths, coded ids. Files
are in order of their part numbers. Rows that share a doc_id are in order of
their texts; null doc_ids come first.

Defined results: a null text counts as empty, so it is the end id alone; an
empty table gives files without segments and an empty result; further columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import range_coder
from lodestone.llm.common import scratch_path, written
from lodestone.llm.wordids import crc_of, vocabulary, word_ids

END_ID = 1
MAGIC = b"LTF2"
_HEAD = "<4sQQQ"
#: Bytes of texts whose ids are made together.
CHUNK = 20 << 20
#: Ids after which a segment is closed, at a document's end.
SEGMENT = 1 << 23
#: Parts whose sizes are summed as one before offsets are added up over all.
GROUPED = 1024
#: Most files whose offsets are broadcast.
BROADCAST_FILES = 100_000


def pack_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in docs], "u1")
    keys = np.array([d or 0 for d in docs], "<i8")
    body = null.tobytes() + keys.tobytes() + np.array(lengths, "<u8").tobytes() + range_coder.encode(ids)
    return struct.pack(_HEAD, MAGIC, len(body), len(docs), len(ids)) + body


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(documents, ids, body) of each segment of a file."""
    at, head = 0, struct.calcsize(_HEAD)
    while at < len(data):
        magic, size, docs, ids = struct.unpack_from(_HEAD, data, at)
        if magic != MAGIC or at + head + size >= len(data):
            raise ValueError("not a file of token ids")
        yield docs, ids, data[at + head : at + head + size]
        at += head + size + 1


def unpack_segment(n: int, body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment of n documents."""
    null = np.frombuffer(body, "u1", n)
    keys = np.frombuffer(body, "<i8", n, n)
    lengths = np.frombuffer(body, "<u8", n, 9 * n).astype("i8")
    docs = [None if e else k for e, k in zip(null.tolist(), keys.tolist(), strict=True)]
    return docs, lengths, range_coder.decode(body[17 * n :])


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of ``docs`` (doc_id, text) to files in the folder ``path``; returns it."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    vocabulary_path = tokenizer or vocabulary()

    def run(batches):
        import pyarrow as pa

        each = word_ids(vocabulary_path).each
        keys, parts, total = [], [], 0

        def closed():
            data = pack_segment(keys, [len(p) for p in parts], np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), each(b.column(1), end_id, CHUNK), strict=True):
                keys.append(doc)
                parts.append(ids)
                total += len(ids)
                if total >= SEGMENT:
                    yield closed()
                    keys, parts, total = [], [], 0
        if keys:
            yield closed()

    spread = docs.select("doc_id", "text").repartitionByRange("doc_id")
    coded = spread.sortWithinPartitions("doc_id", "text").mapInArrow(run, "segment binary")
    # The cast keeps bytes as they are, and so does the sink.
    coded.select(F.col("segment").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(part, content) of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    part = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    return files.select(part.alias("part"), "content")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, start): the ids of all files before each, from the segments' heads."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = [sum(ids for _, ids, _ in segments(data)) for data in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["part", "n_ids"])

    sizes = written(_files(spark, path).mapInArrow(run, "part long, n_ids long"), "sizes")
    sizes = sizes.withColumn("grp", F.floor(F.col("part") / GROUPED))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # one row for each GROUPED files
    groups = sizes.groupBy("grp").agg(F.sum("n_ids").alias("ids"))
    groups = groups.select("grp", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    out = sizes.withColumn("inside", inside).join(groups, "grp")
    return out.select("part", (F.col("base") + F.col("inside")).alias("start"))


def _each(spark: SparkSession, path: str, make, columns: str) -> DataFrame:
    """doc_id, start and ``make(ids)`` for each document of the files; a file is one task's work."""
    schema = f"part long, doc_id long, inside long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in schema.split(", ")]
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = 0
                for n, n_ids, body in segments(data.as_py()):
                    docs, lengths, ids = unpack_segment(n, body)
                    ends = np.cumsum(lengths).tolist()
                    rows = [(part, d, at + e - k, *make(ids[e - k : e])) for d, k, e in zip(docs, lengths.tolist(), ends, strict=True)]
                    at += n_ids
                    for k in range(0, len(rows), 10_000):
                        some = zip(*rows[k : k + 10_000], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds, strict=True)], names=names)

    bases = written(starts(spark, path), "starts")
    if bases.count() <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    out = _files(spark, path).mapInArrow(run, schema).join(bases, "part")
    return out.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), *names[3:])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document, from the files."""
    return _each(spark, path, lambda ids: (ids.tolist(),), "ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    return _each(spark, path, lambda ids: (len(ids), crc_of(ids)), "n_tokens long, ids_crc32 long")
