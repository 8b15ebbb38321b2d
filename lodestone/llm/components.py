"""Connected components of a graph given as a table of links.

Large-star and small-star steps alternate until no link changes (Kiveris et
al., Connected Components in MapReduce and Beyond). Each step is an aggregation
with map-side combining and a join back, so a node with very many links is an
ordinary skewed join. Links are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for each node of ``links`` (a, b).

    ``links`` may repeat, go either way and join a node to itself; null ends
    are left out.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(ends.where("a > b").distinct(), "links")
    before = _state(links)
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        to_least = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = to_least.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        links = written(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
