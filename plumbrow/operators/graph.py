"""Betweenness centrality of a lineage graph, after Brandes (2001), as joins over all sources at once."""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.operators.lineage import numbered
from plumbrow.sources.shared import cut

log = logging.getLogger(__name__)

class _Level(NamedTuple):
    """``s, v, sigma``: nodes at one distance from s and the number of shortest paths to them."""

    df: DataFrame
    rows: int


class _Graph(NamedTuple):
    edges: DataFrame
    weights: DataFrame  # of ends that stand for several

    def below(self, level: _Level, *columns: str) -> DataFrame:
        """``level`` joined with its edges; adaptive execution splits the rows of a hub."""
        return level.df.select(*columns).join(self.edges, F.col("v") == F.col("src"))


def _set_of(column: str) -> list[Column]:
    """What stands for the set of values of a group, whatever its size: their number and three 64-bit sums
    of hashes. Two different sets agree in all with a chance below 2**-100."""
    return [
        F.count(F.lit(1)).alias("k0"),
        *(F.bit_xor(F.xxhash64(column, F.lit(i))).alias(f"k{i}") for i in (1, 2, 3)),
    ]


def _twins(links: DataFrame, end: str, other: str) -> DataFrame:
    """``n, first, weight`` for each node that only ever is the ``end`` of a link: those with the same neighbours are one group.

    Neighbours are summed up for all nodes, which each task does before the shuffle, and the nodes are picked from that table: links are
    neither joined nor sorted, and each step holds one table of nodes in memory instead of all of them at once.
    """
    others = cut(links.select(F.col(other).alias("n")).distinct(), "others")
    of = cut(links.groupBy(F.col(end).alias("n")).agg(*_set_of(other)), "neighbours")
    of = cut(of.join(others, "n", "left_anti"), "ends")
    keys = ["k0", "k1", "k2", "k3"]
    groups = cut(of.groupBy(*keys).agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("weight")), "groups")
    return of.join(groups, keys).select("n", "first", "weight")


def reduced(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without repeated ends, and ``n, weight`` for the ends that stand for others.

    Sinks with the same predecessors lie on no path between others and are met by the same paths, so
    one stands for all; likewise sources with the same successors. Sources that lead to sinks only are left
    out, as no path of theirs has a node in between.
    """
    sinks = cut(_twins(links, "dst", "src"), "sinks")
    other_sinks = sinks.filter("n <> first").select(F.col("n").alias("dst"))
    links = cut(links.join(other_sinks, "dst", "left_anti").select("src", "dst"), "links")
    through = links.join(sinks.select(F.col("n").alias("dst")), "dst", "left_anti").select(F.col("src").alias("n"))
    sources = cut(_twins(links, "src", "dst").join(through, "n", "left_semi"), "sources")
    starts = links.select(F.col("src").alias("n")).distinct().join(links.select(F.col("dst").alias("n")), "n", "left_semi")
    starts = starts.union(sources.filter("n = first").select("n"))
    links = cut(links.join(starts.withColumnRenamed("n", "src"), "src", "left_semi").select("src", "dst"), "links")
    weights = sinks.union(sources).filter("n = first AND weight > 1").select("n", "weight")
    return links, cut(weights, "weights")


def _paths_below(first: DataFrame, graph: _Graph) -> list[_Level]:
    """Breadth-first levels. The first one is the edges themselves: one path of length 1 each."""
    levels = [_Level(first, first.count())]
    while levels[-1].rows:
        step = (
            graph.below(levels[-1], "s", "v", "sigma")
            .filter("s <> dst")
            .groupBy("s", F.col("dst").alias("v"))
            .agg(F.sum("sigma").alias("sigma"))
        )
        seen = reduce(DataFrame.union, [x.df.select("s", "v") for x in levels])
        level = cut(step.join(seen, ["s", "v"], "left_anti").select("s", "v", "sigma"), "paths")
        levels.append(_Level(level, level.count()))
    return levels[:-1]


def _dependencies(levels: list[_Level], graph: _Graph) -> list[DataFrame]:
    """From the deepest level up, ``s, v, delta``: how far the paths of s depend on v.

    Each level steps down its edges again, as on the way out, so only nodes that a source reached
    are paired with their successors; going back up the edges would also meet every other
    predecessor of a hub. The carried shares are summed per (s, v) in each task before the shuffle.
    """
    sums = []
    below = None
    for level in reversed(levels):
        if below is None:
            known = level.df.withColumn("delta", F.lit(0.0))
        else:
            carried = (
                graph.below(level, "s", "v")
                .select("s", "v", F.col("dst").alias("w"))
                .join(below, ["s", "w"])
                .groupBy("s", "v")
                .agg(F.sum("coefficient").alias("carried"))
            )
            known = level.df.join(carried, ["s", "v"], "left").withColumn(
                "delta", F.col("sigma") * F.coalesce("carried", F.lit(0.0))
            )
            known = cut(known.select("s", "v", "sigma", "delta"), "dependencies")
            sums.append(known.select("s", "v", "delta"))
        known = known.join(graph.weights.withColumnRenamed("n", "v"), "v", "left")
        share = (F.coalesce("weight", F.lit(1)) + F.col("delta")) / F.col("sigma")
        below = known.select("s", F.col("v").alias("w"), share.alias("coefficient"))
    return sums


def betweenness(nodes: DataFrame | None, edges: DataFrame, batches: int = 1) -> DataFrame:
    """``id, betweenness, centrality`` of a directed, unweighted graph, end points not counted.

    ``betweenness`` is the plain sum, ``centrality`` is divided by (n-1)(n-2), 0 for fewer than three
    nodes. Neither is rounded: in a large graph small values are what tells a hub from an orphan. ``nodes(id)`` may hold nodes without edges; ends of
    edges count as nodes, and repeated edges and self-loops do not count.

    Ends with the same neighbours are merged first (see ``reduced``). State is one row per (remaining
    source, node below it), kept in written tables; its size is logged. ``batches`` runs the
    sources in that many groups, which divides the size of that state; the result is the same.
    """
    ids, links = numbered(nodes, edges)
    n = ids.count()
    links, weights = reduced(links)
    graph = _Graph(links, weights)
    sums: list[DataFrame] = []
    state = 0
    for b in range(batches):
        first = links.select(F.col("src").alias("s"), F.col("dst").alias("v"), F.lit(1.0).alias("sigma"))
        if batches > 1:
            first = first.filter(F.pmod(F.hash("s"), F.lit(batches)) == b)
        levels = _paths_below(first, graph)
        state += sum(x.rows for x in levels)
        sums += _dependencies(levels, graph)
    log.info("betweenness of %d nodes: %d rows of state", n, state)
    if sums:
        of_sources = reduce(DataFrame.union, sums).join(weights.withColumnRenamed("n", "s"), "s", "left")
        weighted = F.col("delta") * F.coalesce("weight", F.lit(1))
        total = of_sources.groupBy("v").agg(F.sum(weighted).alias("total"))
        out = ids.join(total.withColumnRenamed("v", "n"), "n", "left")
    else:
        out = ids.withColumn("total", F.lit(0.0))
    scale = 1.0 / ((n - 1.0) * (n - 2.0)) if n > 2 else 0.0
    plain = F.coalesce("total", F.lit(0.0))
    return out.select("id", plain.alias("betweenness"), (plain * F.lit(scale)).alias("centrality"))
