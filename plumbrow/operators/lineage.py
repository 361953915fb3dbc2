"""Lineage edges and what follows from them: downstream reach and node roles.

Edges are ``src, dst``, by default from upstream to downstream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.sources.shared import cut

UPSTREAM_TO_DOWNSTREAM = "upstream_to_downstream"
CHILD_TO_PARENT = "child_to_parent"

# The layers of a pipeline, each feeding the next.
LAYERS = ("raw", "staging", "mart")


def fk_edges(
    registry: DataFrame,
    fks: DataFrame,
    direction: str = UPSTREAM_TO_DOWNSTREAM,
    upstream: DataFrame | None = None,
) -> DataFrame:
    """Edges from ``fks(urn, target_table)``: the target is found by table name in every domain.

    The referenced table is the upstream one; ``child_to_parent`` turns the edges round.
    A child that is not registered has no edges. With ``upstream(id)`` only the edges of these tables are
    built: references to others are dropped before anything is shuffled by child.
    """
    keys = fks.select(F.col("urn").alias("child"), F.col("target_table").alias("table"))
    children = registry.select(F.col("urn").alias("child"))
    parents = registry.select("table", F.col("urn").alias("parent"))
    if upstream is not None:
        parents = parents.join(upstream.select(F.col("id").alias("parent")), "parent", "left_semi")
        keys = keys.join(parents.select("table"), "table", "left_semi")
    # Distinct after the join: both need the rows of a child together, so one shuffle serves both, and only the second join moves them again.
    pairs = keys.join(children, "child", "left_semi").distinct().join(parents, "table")
    # Distinct as they are: a child meets a target once, and a parent has one table name.
    if direction == CHILD_TO_PARENT:
        return pairs.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    if direction != UPSTREAM_TO_DOWNSTREAM:
        raise ValueError(f"unknown direction {direction!r}")
    return pairs.select(F.col("parent").alias("src"), F.col("child").alias("dst"))


def _layered(registry: DataFrame) -> DataFrame:
    """``domain, urn, layers``: positions in LAYERS, by whole word of the table name."""
    words = F.split(F.lower("table"), "[^a-z0-9]+")
    found = F.array(*[F.when(F.array_contains(words, w), F.lit(i)) for i, w in enumerate(LAYERS)])
    return registry.select("domain", "urn", F.array_compact(found).alias("layers"))


def layer_edges(registry: DataFrame) -> DataFrame:
    """Edges by naming convention: within a domain every raw table feeds every staging table, and
    every staging table every mart.

    The edge list is the answer itself, so its size is what this costs; where a domain has so many tables that the
    list cannot be written out, ``layer_links`` holds the same lineage, ``layer_downstream`` follows it and ``layer_roles`` tells the ends.
    """
    nodes = _layered(registry)
    src = nodes.selectExpr("domain", "urn AS src", "layers AS a", "explode(transform(layers, x -> x + 1)) AS layer")
    dst = nodes.selectExpr("domain", "urn AS dst", "layers AS b", "explode(layers) AS layer")
    # Tables of two layers may meet twice; the lower meeting counts, so no distinct is needed.
    earlier = "exists(a, x -> x + 1 < layer AND array_contains(b, x + 1))"
    pairs = src.join(dst, ["domain", "layer"]).filter(f"src <> dst AND NOT {earlier}")
    return pairs.select("src", "dst")


def layer_links(registry: DataFrame) -> DataFrame:
    """The same lineage through one junction per domain and layer change: two links per table.

    ``a`` feeds ``b`` in ``layer_edges`` exactly if ``a`` links to a junction that links to ``b``
    (a table does not feed itself, and one without a domain nothing). Linear in the registry, a map over it, and nothing is paired.
    """
    last = len(LAYERS) - 1

    def junction(layer: Column) -> Column:
        return F.concat_ws("|", F.lit("junction"), F.col("domain"), layer.cast("string"))

    layer = F.col("layer")
    ends = F.array(
        F.when(layer < last, F.struct(F.col("urn").alias("src"), junction(layer + 1).alias("dst"))),
        F.when(layer > 0, F.struct(junction(layer).alias("src"), F.col("urn").alias("dst"))),
    )
    nodes = _layered(registry).filter("domain IS NOT NULL").select("domain", "urn", F.explode("layers").alias("layer"))
    links = nodes.select(F.explode(ends).alias("e")).filter("e is not null")
    return links.select("e.src", "e.dst")


def discover_edges(registry: DataFrame, fks: DataFrame) -> DataFrame:
    """Foreign-key edges; if there are none at all, the naming convention."""
    edges = cut(fk_edges(registry, fks), "fk-edges")
    return layer_edges(registry) if edges.isEmpty() else edges


def _declared(mapping: DataFrame) -> DataFrame:
    if "upstreams" in mapping.columns:
        mapping = mapping.select("downstream", F.explode("upstreams").alias("upstream"))
    return mapping.select("downstream", "upstream").distinct()


def declared_edges(mapping: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges from ``mapping(downstream, upstreams)`` or ``(downstream, upstream)``, by table name.

    Names that are not registered are left out; ``unknown_names`` lists them.
    """
    names = registry.select("table", "urn")
    return (
        _declared(mapping)
        .join(names.select(F.col("table").alias("upstream"), F.col("urn").alias("src")), "upstream")
        .join(names.select(F.col("table").alias("downstream"), F.col("urn").alias("dst")), "downstream")
        .select("src", "dst")
    )


def unknown_names(mapping: DataFrame, registry: DataFrame) -> DataFrame:
    """``table, role``: declared names that no registered table has."""
    ends = _declared(mapping).select(
        F.inline(
            F.array(
                F.struct(F.col("downstream").alias("table"), F.lit("downstream").alias("role")),
                F.struct(F.col("upstream").alias("table"), F.lit("upstream").alias("role")),
            )
        )
    )
    return ends.distinct().join(registry.select("table"), "table", "left_anti")


def graph_nodes(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``id``: the given nodes and all ends of edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ends if nodes is None else nodes.select("id").union(ends)).distinct()


def numbered(nodes: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and ``src, dst`` with numbers for names, without repeated edges and self-loops.

    Dataset names are long texts, and iterative jobs shuffle them many times; numbers take 8 bytes.
    They are written down before use, so a task that runs again cannot give out others.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    ids = cut(graph_nodes(nodes, edges).withColumn("n", F.monotonically_increasing_id()), "nodes")
    short = (
        edges.join(ids.select(F.col("id").alias("src"), F.col("n").alias("s")), "src")
        .join(ids.select(F.col("id").alias("dst"), F.col("n").alias("d")), "dst")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"))
    )
    return ids, cut(short, "edges")


def _hashed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and ``src, dst`` as ``numbered`` has them, but with a name's hash for its number, so that no join replaces names.

    Edges are made from the names whenever they are read, and repeated ones stay. The names are counted against the hashes: if
    two share one, numbers are dealt out instead.
    """
    number = lambda c: F.xxhash64(F.col(c).cast("string"))
    edges = cut(edges.select("src", "dst").filter("src <> dst"), "edges")
    ids = cut(graph_nodes(nodes, edges).filter("id IS NOT NULL").withColumn("n", number("id")), "nodes")
    if ids.select("n").distinct().count() < ids.count():
        return numbered(nodes, edges)
    return ids, edges.select(number("src").alias("src"), number("dst").alias("dst"))


def downstream(edges: DataFrame, starts: DataFrame, hops: int | None = 1) -> DataFrame:
    """``start, node, distance``: what lies below each of ``starts(id)``.

    ``hops=1`` gives the direct ones in a single join; None goes on until nothing new is found. Rounds
    work on hashes instead of names, and on the starts of a node as bits, 64 to a number: a round moves the bits found last along the
    edges and keeps those that are new, so cycles end and a pair keeps its shortest distance. Earlier rounds are not
    read again, only what they add up to; nodes that feed nothing are left out before the edges are. A start that a cycle leads back to is not below itself.
    """
    roots = starts.select(F.col("id").alias("start")).distinct()
    if hops == 1:
        direct = edges.select("src", "dst").filter("src <> dst")
        near = roots.join(direct, roots["start"] == direct["src"])
        return near.select("start", F.col("dst").alias("node")).distinct().withColumn("distance", F.lit(1))
    ids, links = _hashed(roots.select(F.col("start").alias("id")), edges)
    own = roots.join(ids.withColumnRenamed("id", "start"), "start").select(F.col("n").alias("node"), F.col("start").alias("name"))
    own = cut(own.withColumn("start", F.monotonically_increasing_id()), "starts")
    feeding = cut(links.select(F.col("src").alias("node")).distinct(), "feeding")
    # The starts that have reached a node, 64 in a number: ``word`` and the bits of ``mask``.
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(start % 64 AS INT))")
    seen = own.select("node", F.floor(F.col("start") / 64).alias("word"), bit.alias("mask"))
    level, levels = seen, []
    while hops is None or len(levels) < hops:
        level = cut(level.join(feeding, "node", "left_semi"), "feeding-reach")
        if level.isEmpty():
            break
        if levels:
            seen = cut(seen.union(levels[-1]).groupBy("node", "word").agg(F.bit_or("mask").alias("mask")), "seen")
        step = level.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
        known = seen.select("node", "word", F.col("mask").alias("known"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
        level = step.join(known, ["node", "word"], "left").select("node", "word", fresh.alias("mask")).filter("mask <> 0")
        level = cut(level, "reach")
        if level.isEmpty():
            break
        levels.append(level)
    if not levels:
        return starts.sparkSession.createDataFrame([], "start string, node string, distance int")
    found = reduce(DataFrame.union, [x.withColumn("distance", F.lit(d)) for d, x in enumerate(levels, 1)])
    # Nodes get their names while their starts are still bits.
    found = found.join(ids.select(F.col("n").alias("node"), "id"), "node")
    bits = "explode(filter(sequence(0, 63), b -> getbit(mask, b) = 1)) AS bit"
    pairs = found.selectExpr("id", "word", "distance", bits).selectExpr("id", "word * 64 + bit AS start", "distance")
    pairs = pairs.join(own.select("start", "name"), "start")
    return pairs.select(F.col("name").alias("start"), F.col("id").alias("node"), "distance")


def layer_downstream(registry: DataFrame, starts: DataFrame, hops: int | None = 1) -> DataFrame:
    """``downstream`` over ``layer_edges``, without that list: ``start, node, distance``.

    It goes along ``layer_links``, where every second node is a junction, so a hop is two rounds and distances are halved. A
    junction passes on each start once, however many tables feed it: the work grows with the tables and the pairs that
    come out, not with the pairs of tables that feed each other.
    """
    links = layer_links(registry)
    found = downstream(links, starts, None if hops is None else 2 * hops).filter("distance % 2 = 0")
    return found.select("start", "node", F.expr("distance div 2").cast("int").alias("distance"))


def discover_downstream(registry: DataFrame, fks: DataFrame, starts: DataFrame, hops: int | None = 1) -> DataFrame:
    """``downstream`` over ``discover_edges``: foreign keys or, if there are none, the naming convention, whose pairs are not written out."""
    edges = cut(fk_edges(registry, fks), "fk-edges")
    if edges.isEmpty():
        return layer_downstream(registry, starts, hops)
    return downstream(edges, starts, hops)


def layer_roles(registry: DataFrame) -> DataFrame:
    """``id, is_root, is_sink, is_isolated`` by ``layer_edges``, as ``node_roles`` has them, from the numbers of tables in each layer.

    A table has something below it if the layer after one of its own holds a table other than itself. Numbers are pre-aggregated, so a
    domain with a third of all tables is one row of each task, and the table joined with is as small as the domains.
    """
    nodes = _layered(registry)
    layers = nodes.select("domain", F.explode("layers").alias("layer")).groupBy("domain", "layer").agg(F.count(F.lit(1)).alias("n"))
    tables = [F.coalesce(F.max(F.when(F.col("layer") == i, F.col("n"))), F.lit(0)) for i in range(len(LAYERS))]
    counts = cut(layers.groupBy(F.col("domain").alias("of")).agg(F.array(*tables).alias("tables")), "layers")
    joined = nodes.join(counts, F.col("domain") == F.col("of"), "left")

    def other(step: int) -> Column:
        def feeds(x: Column) -> Column:
            inside = (x + step).between(0, len(LAYERS) - 1)
            return inside & (F.get("tables", x + step) > F.array_contains("layers", x + step).cast("int"))

        return F.col("of").isNotNull() & F.exists("layers", feeds)

    above, below = other(-1), other(1)
    return joined.select(F.col("urn").alias("id"), (~above).alias("is_root"), (~below).alias("is_sink"), (~above & ~below).alias("is_isolated"))


def node_roles(
    nodes: DataFrame | None, edges: DataFrame, centrality: DataFrame | None = None
) -> DataFrame:
    """``id, is_root, is_sink, is_isolated, is_orphan``.

    A root is never downstream, a sink never upstream, an isolated node neither. An orphan has
    centrality 0 and is no root; without ``centrality(id, centrality)`` all are taken as 0.
    Hubs are reduced to one row per task before the shuffle.
    """
    touch = edges.filter("src <> dst").select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(True).alias("out"), F.lit(False).alias("inn")),
                F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"), F.lit(True).alias("inn")),
            )
        )
    )
    if nodes is not None:
        lone = nodes.select("id", F.lit(False).alias("out"), F.lit(False).alias("inn"))
        touch = touch.union(lone)
    out = touch.groupBy("id").agg(F.max("out").alias("out"), F.max("inn").alias("inn"))
    score: Column = F.lit(0.0)
    if centrality is not None:
        out = out.join(centrality.select("id", "centrality"), "id", "left")
        score = F.coalesce("centrality", F.lit(0.0))
    return out.select(
        "id",
        (~F.col("inn")).alias("is_root"),
        (~F.col("out")).alias("is_sink"),
        (~F.col("inn") & ~F.col("out")).alias("is_isolated"),
        ((score == 0.0) & F.col("inn")).alias("is_orphan"),
    )
