"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one row with a count. Centroids are fitted on a sample of at
most ``SAMPLE`` distinct vectors, taken by hash order; all vectors are then
assigned. A vector's home A is its nearest cell; it also asks every cell B whose
centroid is at most ``r |A - B| / 2`` less similar, where r is the distance of
unit vectors at the least cosine. A pair is found if one of the two asks the
other's home, and no pair is lost: if x is at home in A and y in B, the two gaps
``x.(A - B)`` and ``y.(B - A)`` add up to ``(x - y).(A - B) <= r |A - B|``, so the
smaller is at most half of that. Within a cell, blocks of asking and home vectors are
multiplied as matrices in double precision; a pair seen from both sides is
credited to the asking side only, and one seen from one side to both, so links
are counted once. Tasks return, for each vector, its number of links and the
least member of its group there, never the pairs.

Cells of many vectors are dealt in blocks of home and of asking vectors, each
pair of blocks a group of its own. What the driver sees is bounded: the sample
and a count for each of at most ``MOST_CELLS`` cells.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; repeated
rows each get a row and link with each other; ties of cells go to the lowest; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import unused, written
from lodestone.llm.components import connected_components
from lodestone.llm.simhash import Groups

COSINE = 0.95
SAMPLE = 20_000
#: Vectors a cell beyond ``LEAST_CELLS`` cells: what asking moves grows with the cells, what is multiplied does not.
PER_CELL = 32_768
LEAST_CELLS, MOST_CELLS = 64, 4096
BROADCAST_CELLS = 100_000
#: Added to margins for rounding.
SLACK = 1e-9
ROUNDS = 12
HOME_BLOCK = 4096
ASK_BLOCK = 16384


def unit_vectors(column) -> np.ndarray:
    """Rows of an Arrow list column, scaled to length 1."""
    flat = np.asarray(column.flatten(), dtype="f8")
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo("f8").smallest_subnormal)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; seeded, an empty cell keeps its centroid."""
    rng = np.random.default_rng(42)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def _valid(v):
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # coalesce: an array with null components makes exists() null
    return F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))


def margins(centroids: np.ndarray, homes: np.ndarray, cosine: float) -> np.ndarray:
    """How much less similar than its home in ``homes`` a cell may be to be asked: a row a home, a column a cell."""
    squares = (centroids * centroids).sum(axis=1)
    apart = squares[homes, None] + squares - 2 * centroids[homes] @ centroids.T
    return 0.5 * np.sqrt(max(2 - 2 * cosine, 0) * apart.clip(0)) + SLACK


def _assign(distinct: DataFrame, centroids: np.ndarray, length: int, cosine: float) -> DataFrame:
    """Adds ``home`` and ``asks`` (cells); vectors of another length share the cell -length."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = np.asarray(b.column("v").value_lengths())
            home, asks = -sizes.astype("i8"), [[-int(s)] for s in sizes]
            rows = np.flatnonzero(sizes == length)
            for at in range(0, len(rows), 2048):
                some = rows[at : at + 2048]
                similar = unit_vectors(b.column("v").take(pa.array(some))) @ centroids.T
                best = similar.argmax(axis=1)
                homes, of = np.unique(best, return_inverse=True)
                asked = similar >= similar.max(axis=1, keepdims=True) - margins(centroids, homes, cosine)[of]
                home[some] = best
                for r, k in zip(some.tolist(), asked, strict=True):
                    asks[r] = np.flatnonzero(k).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home), pa.array(asks, pa.list_(pa.int64()))], names=["node", "n", "v", "home", "asks"]
            )

    return distinct.select("node", "n", "v").mapInArrow(run, "node long, n long, v array<double>, home long, asks array<long>")


def _cell(table, cosine: float):
    """Links of a group: rows of side 0 ask, rows of side 1 are at home."""
    import pyarrow as pa

    side = np.asarray(table.column("side"))
    part = lambda s: table.filter(pa.array(side == s)).combine_chunks()
    ask, at_home = part(0), part(1)
    column = lambda t, c: np.asarray(t.column(c))
    nodes, where = np.unique(np.concatenate([column(ask, "node"), column(at_home, "node")]), return_inverse=True)
    row_a, row_h = where[: ask.num_rows], where[ask.num_rows :]
    links, sets = np.zeros(len(nodes), "i8"), Groups(len(nodes))
    if ask.num_rows and at_home.num_rows:
        x, y = (unit_vectors(t.column("v").combine_chunks()) for t in (ask, at_home))
        n_a, n_h, home = column(ask, "n"), column(at_home, "n"), column(ask, "home")
        asks = at_home.column("asks").combine_chunks()
        cell = np.asarray(asks.flatten())
        owner = np.repeat(np.arange(at_home.num_rows), np.asarray(asks.value_lengths()))
        for at in range(0, len(x), 512):
            near = x[at : at + 512] @ y.T >= cosine
            near &= row_a[at : at + 512, None] != row_h[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            np.add.at(links, row_a[at + i], n_h[j])
            # Does the one at home ask back? Then it is credited when it asks.
            wanted, homes = np.unique(home[at : at + 512], return_inverse=True)
            back = np.zeros((len(y), len(wanted)), bool)
            k = np.searchsorted(wanted, cell)
            hit = (k < len(wanted)) & (wanted[np.minimum(k, len(wanted) - 1)] == cell)
            back[owner[hit], k[hit]] = True
            once = ~back[j, homes[i]]
            np.add.at(links, row_h[j[once]], n_a[at + i[once]])
            sets.join(row_a[at + i], row_h[j])
    told = np.flatnonzero(links > 0)
    told = np.union1d(told, np.flatnonzero(sets.of != np.arange(len(nodes))))
    return pa.table({"node": nodes[told], "root": nodes[sets.of[told]], "links": links[told]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, per_cell: int = PER_CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("ok", _valid(F.col("v")))
    alone = rows.where("NOT ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    # Two hashes, 128 bits, stand for a vector once equal ones have met.
    rows = rows.where("ok").drop("ok").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    distinct = rows.groupBy("k1", "k2", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = distinct.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length, count = (lengths[0], lengths[1]) if lengths else (1, 0)
    sample = distinct.where(F.size("v") == length).orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").toArrow()
    x = unit_vectors(sample.column("v").combine_chunks()) if sample.num_rows else np.ones((1, length))
    cells = min(max(LEAST_CELLS, -(-count // per_cell)), MOST_CELLS)
    assigned = written(_assign(distinct, spherical_kmeans(x, cells), length, cosine), "assigned")

    asking = assigned.withColumn("cell", F.explode("asks"))
    n_ask, n_home = asking.groupBy("cell").count(), assigned.groupBy(F.col("home").alias("cell")).count()
    blocks = n_ask.select("cell", F.ceil(F.col("count") / ASK_BLOCK).alias("asking")).join(
        n_home.select("cell", F.ceil(F.col("count") / HOME_BLOCK).alias("homes")), "cell"
    )
    blocks = written(blocks, "blocks")  # one row a cell: at most MOST_CELLS and one a length
    if blocks.count() <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)
    deal = lambda own, other: (
        F.pmod(F.xxhash64("node"), F.col(own)).alias(f"{own}_block"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col(other))).alias(f"{other}_block"),
    )
    columns = ("cell", "node", "n", "v", "home", "asks")
    ask = asking.join(blocks, "cell").select(*columns, F.lit(0).alias("side"), *deal("asking", "homes"))
    ask = ask.withColumn("homes_block", F.col("homes_block") - 1)
    home = assigned.withColumn("cell", F.col("home")).join(blocks, "cell").select(*columns, F.lit(1).alias("side"), *deal("homes", "asking"))
    home = home.withColumn("asking_block", F.col("asking_block") - 1)
    grouped = ask.unionByName(home).groupBy("cell", "asking_block", "homes_block")
    found = written(grouped.applyInArrow(lambda t: _cell(t, cosine), "node long, root long, links long"), "links")

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = distinct.drop("v").join(roots, "node", "left").join(counted, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(least, "root").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = rows.drop("v").join(member, ["k1", "k2"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)


def dedup(vectors: DataFrame, **options) -> DataFrame:
    """One row of each group of ``vectors`` stays: that of the least vec_id (nulls last), of equal ones any."""
    row = unused("__row", vectors)
    numbered = written(vectors.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("vec_id"), "embedding"), **options)
    ranked = found.select(F.col("vec_id").alias(row), "component_id").join(numbered.select(row, "vec_id"), row)
    best = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", F.col(row).alias("row"))).alias("best"))
    return numbered.join(best.select(F.col("best.row").alias(row)), row, "left_semi").drop(row)
