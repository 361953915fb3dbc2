"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbrow.llm.common import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """Each ``u`` with the smallest of itself and its partners; written, so that the join that follows
    deals out both sides itself and adaptive execution can split a hub."""
    return cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "smallest")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges(a, b)``: root is the smallest node that can be reached.

    Ends are bigint; loops and repeated edges do not count, a node with loops only is left out. Every
    round is a written table; rounds grow with the logarithm of the longest chain. No edges, no rows.
    """
    pairs = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        least = _smallest(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
