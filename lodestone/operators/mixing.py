"""Sampling, mixing and packing of training sequences.

Draws are hashes of seed, epoch and row, so they hang neither on the order of
rows nor on how many tasks run. Best-fit packing is sequential; it runs in as
many independent groups as asked for, each of which is one task's work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import strings as S
from lodestone.operators.running import numbered, running_totals
from lodestone.operators.runs import per_group


def normalised_ratios(ratios: dict[str, float]) -> dict[str, float]:
    if not ratios or min(ratios.values()) <= 0:
        raise ValueError("ratios must be positive")
    return {k: v / sum(ratios.values()) for k, v in ratios.items()}


def sampled(df: DataFrame, dataset: str, row: str, ratios: dict[str, float], seed: int, path: str, epoch: int = 0) -> DataFrame:
    """max(1, int(total * ratio)) rows of each dataset: by lowest hash if it has so many, else drawn with repetition."""
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("size"))
    shares = normalised_ratios(ratios)
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col(dataset)]
    total = df.count()
    sizes = sizes.select(dataset, "size", F.greatest(F.lit(1), (share * total).cast("int")).alias("target")).where("target IS NOT NULL")
    u = lambda *p: S.uniform(F.lit(seed), F.lit(epoch), *p)
    sizes = F.broadcast(sizes)  # one row a dataset
    ranked = df.join(sizes.where("target <= size"), dataset).withColumn("u", u(F.col(dataset), F.col(row)))
    few = numbered(ranked, [dataset], ["u", row], f"{path}/few").where("k < target").drop("k", "u", "size", "target")
    more = numbered(df.join(sizes.where("target > size"), dataset, "left_semi"), [dataset], [row], f"{path}/more", "local")
    draws = slots(sizes.where("target > size"), "target", "draw").withColumn("draw", F.col("draw") + 1)
    draws = draws.select(dataset, F.floor(u(F.col(dataset), F.lit("draw"), F.col("draw")) * F.col("size")).alias("local"))
    return few.unionByName(draws.join(more, [dataset, "local"]).drop("local"))


def slots(df: DataFrame, count: str, name: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row as often as ``count`` says, with a number from 0: in chunks, so that no array grows with the count."""
    parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk)))).where(f"{count} > 0")
    least = F.least(F.lit(chunk), F.col(count) - F.col("__part") * chunk)
    out = parts.repartition("__part").withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), least.cast("long") - 1)))
    return out.withColumn(name, F.col("__part") * chunk + F.col("__at")).drop("__part", "__at")


def largest_remainders(shares: DataFrame, share: str, name: str, slots: int) -> DataFrame:
    """Whole slots for shares that sum to 1: floors, and one more for the largest remainders, of equals by name."""
    exact = F.col(share) * slots
    out = shares.withColumn("n", F.floor(exact + 1e-9)).withColumn("rest", F.round(exact - F.floor(exact + 1e-9), 9))
    left = F.lit(slots) - F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a source
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), name))
    return out.withColumn("n", F.col("n") + F.when(rank <= left, 1).otherwise(0)).drop("rest")


def mixed_batches(df: DataFrame, source: str, row: str, takes: dict[str, int], seed: int, path: str, epoch: int = 0) -> DataFrame:
    """Rows with a batch number: each batch takes so many of each source, in hash order; the scarcest ends it."""
    take = F.create_map(*(F.lit(x) for kv in takes.items() for x in kv))[F.col(source)]
    u = S.uniform(F.lit(seed), F.lit(epoch), F.col(source), F.col(row))
    out = numbered(df.withColumn("take", take).where("take > 0").withColumn("u", u), [source], ["u", row], path).withColumn("batch", F.floor(F.col("k") / F.col("take")))
    out = out.drop("k", "u")
    full = out.groupBy(source, "take").agg(F.count(F.lit(1)).alias("size")).agg(F.min(F.floor(F.col("size") / F.col("take"))).alias("n"))
    return out.crossJoin(F.broadcast(full)).where("batch < n").drop("take", "n")  # full is one row


class BestFit:
    """Room of open bins: the least that fits, of equals the lowest bin."""

    def __init__(self):
        self.room: list[tuple[int, int]] = []

    def take(self, length: int) -> tuple[int, int] | None:
        k = bisect_left(self.room, (length, -1))
        return self.room.pop(k) if k < len(self.room) else None

    def put(self, left: int, b: int) -> None:
        insort(self.room, (left, b))


class FirstFit:
    """Room of bins in a tree of maxima: the lowest bin that fits is found on one path from the top."""

    def __init__(self):
        self.leaves, self.most = 1, [0, 0]

    def take(self, length: int) -> tuple[int, int] | None:
        if self.most[1] < length:
            return None
        k = 1
        while k < self.leaves:
            k = 2 * k if self.most[2 * k] >= length else 2 * k + 1
        return self.most[k], k - self.leaves

    def put(self, left: int, b: int) -> None:
        while b >= self.leaves:
            rows = [self.most[1 << r : 2 << r] for r in range(self.leaves.bit_length())]
            self.leaves *= 2
            self.most = [0, self.most[1], *(x for row in rows for x in (*row, *[0] * len(row)))]
        k = b + self.leaves
        self.most[k] = left
        while k := k // 2:
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])


def bins_of(lengths: list[int], capacity: int, rule) -> list[int]:
    """The bin of each length; one over the capacity is a closed bin of its own."""
    out, n = [], 0
    for length in lengths:
        left, b = (rule.take(length) if length <= capacity else None) or (max(capacity, length), n)
        n += b == n
        out.append(b)
        if left > length or isinstance(rule, FirstFit):
            rule.put(left - length, b)
    return out


def affinity_bins(lengths: list[int], datasets: list, expected: dict, capacity: int) -> list[int]:
    """Best fit, where of bins with equal room the one goes first whose leading dataset lacks most of its expected rows.

    A bin's leading dataset is the one with most rows in it, of equals the least.
    Bins of equal room are kept by leading dataset, lowest bin first, so a choice
    looks at as many as there are datasets.
    """
    rooms: list[int] = []
    at: dict[int, dict[object, list[int]]] = {}
    held: list[Counter] = []
    leader: list = []
    lacking = Counter(expected)
    out = []
    for length, dataset in zip(lengths, datasets, strict=True):
        k = bisect_left(rooms, length) if length <= capacity else len(rooms)
        if k < len(rooms):
            left = rooms[k]
            lead = min(at[left], key=lambda d: (-lacking[d], at[left][d][0]))  # noqa: B023
            b = heappop(at[left][lead])
            if not at[left][lead]:
                del at[left][lead]
            if not at[left]:
                del at[left], rooms[k]
        else:
            left, b = max(capacity, length), len(held)
            held.append(Counter())
            leader.append(dataset)
        held[b][dataset] += 1
        if (-held[b][dataset], dataset) < (-held[b][leader[b]], leader[b]):
            leader[b] = dataset
        lacking[dataset] -= 1
        out.append(b)
        if left > length and length <= capacity:
            left -= length
            if left not in at:
                at[left] = {}
                insort(rooms, left)
            heappush(at[left].setdefault(leader[b], []), b)
    return out


def rank_local(df: DataFrame, world: int, path: str, decreasing: bool = True) -> DataFrame:
    """Rows (row_id, length and more) with ``pack_group``: the k-th of the whole order goes to rank k mod world."""
    order = [F.desc("length"), F.asc("row_id")] if decreasing else [F.asc("row_id")]
    ranked = running_totals(df, [], order, {"k": F.lit(1).cast("long")}, path)
    return ranked.withColumn("pack_group", F.pmod(F.col("k") - 1, F.lit(world))).drop("k")


def groups_for(df: DataFrame, rows_per_group: int = 200_000) -> int:
    """Independent groups to pack in, so that one holds about so many rows."""
    return max(1, -(-df.count() // rows_per_group))


def pack(df: DataFrame, capacity: int, path: str, groups: int | None = None, rule: str = "best", decreasing: bool = True) -> DataFrame:
    """(pack_group, row_id, bin) of rows (row_id, length).

    ``best``: the bin with the least room that fits, of equals the lowest number;
    ``first``: the first bin that fits. Longer rows first, unless not
    ``decreasing`` (then in order of row_id). A row over the capacity is a closed bin of its own.
    Groups (by default one for 200,000 rows) pack by themselves; the order's rows are dealt to them in turn.
    """
    dealt = rank_local(df.select("row_id", "length"), groups or groups_for(df), path, decreasing).withColumn("longest", -F.col("length"))
    order = ["longest", "row_id"] if decreasing else ["row_id"]
    make = {"best": BestFit, "first": FirstFit}[rule]

    def run(group: dict) -> dict:
        return {"pack_group": group["pack_group"], "row_id": group["row_id"], "bin": bins_of(group["length"].tolist(), capacity, make())}

    return per_group(dealt, ["pack_group"], order, run, "pack_group long, row_id long, bin int")


def affinity_pack(df: DataFrame, capacity: int, expected: dict[str, int], path: str, groups: int | None = None) -> DataFrame:
    """(pack_group, row_id, bin) of rows (row_id, length, dataset) by ``affinity_bins``, longer rows first."""
    n = groups or groups_for(df)
    dealt = rank_local(df.select("row_id", "length", "dataset"), n, path).withColumn("longest", -F.col("length"))

    def run(group: dict) -> dict:
        share = {k: v / n for k, v in expected.items()}
        bins = affinity_bins(group["length"].tolist(), list(group["dataset"]), share, capacity)
        return {"pack_group": group["pack_group"], "row_id": group["row_id"], "bin": bins}

    return per_group(dealt, ["pack_group"], ["longest", "row_id"], run, "pack_group long, row_id long, bin int")


def rank_bins(bins: DataFrame, bin_id: str, world: int) -> DataFrame:
    """Bins dealt to ranks in turn; ranks that would be short repeat the first bins."""
    n = bins.count()
    short = -n % world
    out = bins.select(F.col(bin_id), F.pmod(F.col(bin_id), F.lit(world)).alias("rank"), F.lit(0).alias("repeat"))
    if not n or not short:
        return out
    again = bins.sparkSession.range(short).select((F.col("id") % n).alias(bin_id), F.pmod(F.col("id") + n, F.lit(world)).alias("rank"), F.lit(1).alias("repeat"))
    return out.unionByName(again)


def equal_counts(df: DataFrame, rank: str, item: str, path: str) -> DataFrame:
    """Each rank's items repeated in turn until all ranks have as many as the largest."""
    every = numbered(df, [rank], [item], path)
    sizes = df.groupBy(rank).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.max("size").alias("most"))))  # one row
    turns = slots(sizes, "most", "slot").withColumn("k", F.col("slot") % F.col("size"))
    return turns.join(every, [rank, "k"]).select(rank, "slot", item)


def cycled(df: DataFrame, row: str, n: int, seed: int, path: str) -> DataFrame:
    """(slot, row): the rows in hash order, again and again until there are n."""
    order = numbered(df.select(row).withColumn("u", S.uniform(F.lit(seed), F.col(row))), [], ["u", row], path).drop("u")
    size = order.count()
    turns = df.sparkSession.range(n if size else 0).select(F.col("id").alias("slot"), (F.col("id") % max(size, 1)).alias("k"))
    return turns.join(order, "k").select("slot", row)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> Column:
    """A column that orders rows anew each epoch."""
    return S.uniform(F.lit(seed + epoch), F.col(key))


def packing_efficiency(bins: DataFrame, capacity: int) -> DataFrame:
    """(bins, tokens, efficiency) of packed rows with their lengths."""
    by = bins.groupBy("pack_group", "bin").agg(F.sum("length").alias("tokens"))
    return by.agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("tokens") / capacity), 6).alias("efficiency"))
