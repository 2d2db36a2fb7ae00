"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(row)


def _hook(pairs: DataFrame) -> DataFrame:
    """Each ``u`` with the least of its own and its neighbours' numbers. The
    minimum combines before the shuffle; a hub's rows meet it in a join whose
    skewed partitions AQE splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node with an edge.

    ``edges`` holds (u, v) as whole numbers; self-loops, repeats and both
    directions are allowed, null ends are ignored. Large-star hooks a node's
    larger neighbours to its minimum, small-star its smaller ones; both keep
    components, and the loop ends when the edge set is a set of stars, after
    O(log n) rounds. No edges: no rows.
    """
    tidy = lambda e: e.where("u != v").distinct()
    now = stored(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u IS NOT NULL AND v IS NOT NULL")), "cc-edges")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tidy(_hook(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        hooked = _hook(large)
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            hooked.select("u", F.col("m").alias("v")))
        now = stored(tidy(small), "cc-edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
