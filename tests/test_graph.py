import random
import collections
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import graph, lineage
from plumbrow.operators.catalog import build_registry


def brandes(nodes, edges):
    """Betweenness of a directed graph, the plain way."""
    out = {v: set() for v in nodes}
    for a, b in edges:
        out.setdefault(a, set())
        out.setdefault(b, set())
        if a != b:
            out[a].add(b)
    score = dict.fromkeys(out, 0.0)
    for s in out:
        order, before, sigma, dist = [], {v: [] for v in out}, dict.fromkeys(out, 0.0), {s: 0}
        sigma[s] = 1.0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(out, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def frames(spark, nodes, edges):
    return (
        spark.createDataFrame([(v,) for v in nodes], "id string"),
        spark.createDataFrame(list(edges), "src string, dst string"),
    )


def scores(spark, nodes, edges, **options):
    rows = graph.betweenness(*frames(spark, nodes, edges), **options).collect()
    return {r.id: (r.betweenness, r.centrality) for r in rows}


RETAIL = [
    ("customers", "orders"), ("promotions", "orders"), ("orders", "order_items"), ("products", "order_items"),
    ("suppliers", "products"), ("products", "inventory"), ("warehouses", "inventory"), ("orders", "shipments"),
    ("warehouses", "shipments"), ("orders", "returns"), ("products", "returns"),
]
GOLDEN = [
    (
        [("raw", "staging"), ("staging", "billing"), ("staging", "demographics")],
        [], {"staging": 0.333},
    ),
    ([("raw", "staging"), ("staging", "daily")], [], {"staging": 0.5}),
    (RETAIL, [], {"orders": 0.083, "products": 0.042}),
    (
        [("rp", "sp"), ("sp", "mb"), ("sp", "md"), ("rt", "st"), ("st", "ds")],
        [f"t{i}" for i in range(10)], {"sp": 0.008, "st": 0.004},
    ),
]


@pytest.mark.parametrize("edges,lone,expected", GOLDEN)
def test_golden_values(spark, edges, lone, expected):
    got = scores(spark, lone, edges)
    assert {v: round(c, 3) for v, (_, c) in got.items() if c} == expected


@pytest.mark.parametrize("seed,n,m,batches", [(1, 12, 30, 1), (2, 25, 60, 3), (3, 9, 70, 1)])
def test_against_brute_force(spark, seed, n, m, batches):
    rnd = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)] + ["alone"]
    # Cycles, self-loops, repeated edges, and a hub at the end of a third of them.
    edges = [
        (rnd.choice(nodes[:-1]), "n0" if i % 3 == 0 else rnd.choice(nodes[:-1])) for i in range(m)
    ] + [("n0", "n5"), ("n0", "outside"), ("n1", "n1")]
    expected = brandes(nodes, edges)
    got = scores(spark, nodes, edges + edges[:5], batches=batches)
    assert got.keys() == expected.keys()
    size = len(expected)
    for v, (plain, rounded) in got.items():
        assert plain == pytest.approx(expected[v], abs=1e-9)
        assert rounded == pytest.approx(expected[v] / ((size - 1) * (size - 2)), abs=5.1e-4)


def test_tiny_graphs(spark):
    assert scores(spark, ["a"], []) == {"a": (0.0, 0.0)}
    assert scores(spark, ["a"], [("a", "b")]) == {"a": (0.0, 0.0), "b": (0.0, 0.0)}


def test_an_isolated_node_only_changes_the_scale(spark):
    few, more = scores(spark, [], RETAIL), scores(spark, ["lone"], RETAIL)
    assert {v: b for v, (b, _) in more.items() if v != "lone"} == {v: b for v, (b, _) in few.items()}


def below(edges, start):
    dist, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for a, b in edges:
            if a == v and b not in dist:
                dist[b] = dist[v] + 1
                todo.append(b)
    del dist[start]
    return dist


@pytest.mark.parametrize("hops", [1, 2, None])
def test_downstream(spark, hops):
    rnd = random.Random(8)
    edges = [(f"n{rnd.randint(0, 14)}", f"n{rnd.randint(0, 14)}") for _ in range(25)]
    starts = ["n1", "n2", "n9", "unknown"]
    got = lineage.downstream(*reversed(frames(spark, starts, edges)), hops=hops)
    expected = {
        (s, v, d) for s in starts for v, d in below([e for e in edges if e[0] != e[1]], s).items()
        if hops is None or d <= hops
    }
    rows = [tuple(r) for r in got.select("start", "node", "distance").collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_roles(spark):
    nodes, edges = frames(spark, ["a", "b", "c", "lone"], [("a", "b"), ("b", "c"), ("a", "a")])
    roles = {r.id: tuple(r)[1:] for r in lineage.node_roles(nodes, edges, graph.betweenness(nodes, edges)).collect()}
    assert roles == {  # is_root, is_sink, is_isolated, is_orphan
        "a": (True, False, False, False),
        "b": (False, False, False, False),
        "c": (False, True, False, True),
        "lone": (True, True, True, False),
    }


def registry(spark, tables):
    return build_registry(spark.createDataFrame(tables, "domain string, table string"))


def pairs(df):
    return sorted((r.src.split(",")[1], r.dst.split(",")[1]) for r in df.collect())


def test_foreign_keys_and_fallback(spark):
    reg = registry(spark, [("shop", "raw_a"), ("shop", "staging_a"), ("shop", "mart_a"), ("smart-x", "b"), ("lab", "raw_c")])
    urn = {r.table: r.urn for r in reg.collect()}
    none = spark.createDataFrame([], "urn string, target_table string")
    assert pairs(lineage.discover_edges(reg, none)) == [("shop.raw_a", "shop.staging_a"), ("shop.staging_a", "shop.mart_a")]
    fks = spark.createDataFrame([(urn["mart_a"], "b"), (urn["mart_a"], "b"), ("nobody", "b"), (urn["b"], "nothing")], "urn string, target_table string")
    assert pairs(lineage.discover_edges(reg, fks)) == [("smart-x.b", "shop.mart_a")]
    assert pairs(lineage.fk_edges(reg, fks, lineage.CHILD_TO_PARENT)) == [("shop.mart_a", "smart-x.b")]
    with pytest.raises(ValueError):
        lineage.fk_edges(reg, fks, "sideways")


def test_a_table_of_two_layers_does_not_feed_itself(spark):
    reg = registry(spark, [("d", "raw_staging_t"), ("d", "staging_u"), ("d", "mart_v"), ("d", "datamart")])
    edges = pairs(lineage.layer_edges(reg))
    assert edges == [
        ("d.raw_staging_t", "d.mart_v"), ("d.raw_staging_t", "d.staging_u"), ("d.staging_u", "d.mart_v"),
    ]
    links = lineage.layer_links(reg)
    onward = links.selectExpr("src AS dst", "dst AS far")
    through = links.join(onward, "dst").selectExpr("src", "far AS dst").filter("src <> dst AND src LIKE 'urn%'").distinct()
    assert pairs(through) == edges


def test_declared_lineage(spark):
    reg = registry(spark, [("d", "x"), ("d", "y"), ("d", "z")])
    mapping = spark.createDataFrame([("z", ["x", "y", "gone"]), ("lost", ["x"])], "downstream string, upstreams array<string>")
    assert pairs(lineage.declared_edges(mapping, reg)) == [("d.x", "d.z"), ("d.y", "d.z")]
    assert {tuple(r) for r in lineage.unknown_names(mapping, reg).collect()} == {("gone", "upstream"), ("lost", "downstream")}


def test_layer_pairs_are_not_repeated(spark):
    reg = registry(spark, [("d", "raw_staging_a"), ("d", "staging_mart_b"), ("d", "raw_mart_c"), ("e", "mart_b")])
    edges = pairs(lineage.layer_edges(reg))
    assert edges == [
        ("d.raw_mart_c", "d.raw_staging_a"), ("d.raw_mart_c", "d.staging_mart_b"), ("d.raw_staging_a", "d.raw_mart_c"),
        ("d.raw_staging_a", "d.staging_mart_b"), ("d.staging_mart_b", "d.raw_mart_c"),
    ]


def test_a_wide_layered_graph_keeps_little_state(spark, caplog):
    """100,000 tables in three layers: leaves with the same neighbours are merged, so state is far below n * n."""
    n = 100_000
    edges = spark.range(n).selectExpr("concat('raw', id % 60000) AS src", "concat('staging', id % 30) AS dst").union(
        spark.range(n).selectExpr("concat('staging', id % 30) AS src", "concat('mart', id % 39970) AS dst")
    )
    with caplog.at_level("INFO", logger="plumbrow.operators.graph"):
        got = {r.id: r.betweenness for r in graph.betweenness(None, edges).filter("betweenness > 0").collect()}
    of_raw, of_mart = collections.defaultdict(set), collections.defaultdict(set)
    for i in range(n):
        of_raw[i % 60000].add(i % 30)
        of_mart[i % 39970].add(i % 30)
    raw = collections.Counter(frozenset(x) for x in of_raw.values())
    mart = collections.Counter(frozenset(x) for x in of_mart.values())
    want = collections.Counter()
    for a, x in raw.items():
        for b, y in mart.items():
            for v in a & b:
                want[f"staging{v}"] += x * y / len(a & b)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    state = int(caplog.messages[-1].split(": ")[1].split()[0])
    assert state < 10 * n


def test_downstream_of_many_starts(spark):
    """10,000 starts, more than fit one number, on a graph with cycles."""
    n = 10_000
    edges = [(f"n{i}", f"n{(i + 1) % n if i % 5 else i + 2}") for i in range(n)] + [(f"n{i}", f"n{i - 3}") for i in range(3, n, 50)]
    below = {}
    for a, b in edges:
        if a != b:
            below.setdefault(a, set()).add(b)
    want = set()
    for i in range(n):
        level, found = {f"n{i}"}, {f"n{i}"}
        for d in (1, 2, 3):
            level = {y for x in level for y in below.get(x, ())} - found
            found |= level
            want |= {(f"n{i}", x, d) for x in level}
    starts = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string").repartition(7)
    got = lineage.downstream(spark.createDataFrame(edges, "src string, dst string"), starts, hops=3)
    assert {tuple(r) for r in got.collect()} == want


def _tables(spark, rows):
    return spark.createDataFrame([(d, f"{d}.{t}", t) for d, t in rows], "domain string, urn string, table string")


def test_layers_by_junctions_as_by_pairs(spark):
    """Tables of two layers, of none, a domain without a middle layer, one of a single table, and rows without a domain."""
    rows = [("d", t) for t in ("raw_a", "raw_b", "staging_a", "raw_staging_c", "mart_a", "staging_mart_b", "other")]
    rows += [("e", "raw_a"), ("e", "mart_a"), ("f", "raw_staging_a"), (None, "raw_x"), (None, "staging_x")]
    registry = _tables(spark, rows).withColumn("urn", F.concat_ws(".", "domain", "table"))
    edges, starts = lineage.layer_edges(registry), registry.selectExpr("urn AS id")
    for hops in (1, 2, None):
        want = lineage.downstream(edges, starts, hops)
        got = lineage.layer_downstream(registry, starts, hops)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = lineage.node_roles(starts, edges).select("id", "is_root", "is_sink", "is_isolated")
    assert sorted(map(tuple, lineage.layer_roles(registry).collect())) == sorted(map(tuple, want.collect()))
    none = registry.filter("false")
    assert lineage.layer_downstream(none, starts).count() == 0 and lineage.layer_roles(none).count() == 0


def test_a_domain_of_many_tables_is_not_paired(spark):
    n = 10_000
    registry = spark.range(2 * n).selectExpr(
        "'d' AS domain", "concat('t', id) AS urn", f"concat(if(id < {n}, 'raw_', 'staging_'), id) AS table"
    )
    starts = spark.createDataFrame([("t0",), ("t1",), (f"t{n}",)], "id string")
    fks = spark.createDataFrame([], "urn string, target_table string")
    got = lineage.discover_downstream(registry, fks, starts, hops=None)
    assert {tuple(x) for x in got.groupBy("start", "distance").count().collect()} == {("t0", 1, n), ("t1", 1, n)}
    assert lineage.layer_links(registry).count() == 3 * n  # not n * n
    roles = lineage.layer_roles(registry).groupBy("is_root", "is_sink").count().collect()
    assert {tuple(x) for x in roles} == {(True, False, n), (False, True, n)}


def test_references_are_moved_by_child_and_by_target_only(spark):
    reg = registry(spark, [("d", t) for t in "xyz"])
    urn = {r.table: r.urn for r in reg.collect()}
    fks = [(urn["z"], "x"), (urn["z"], "x"), (urn["z"], "y"), (urn["y"], "x"), ("nobody", "x"), (None, "x"), (urn["x"], None)]
    fks = spark.createDataFrame(fks, "urn string, target_table string")
    names = spark.createDataFrame([tuple(r) for r in reg.select("urn", "table").collect()], "urn string, table string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        edges = lineage.fk_edges(names, fks)
        assert pairs(edges) == [("d.x", "d.y"), ("d.x", "d.z"), ("d.y", "d.z")]
        assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_downstream_does_not_join_names_for_numbers(spark, monkeypatch):
    def numbered(*_):
        raise AssertionError("names were joined")

    monkeypatch.setattr(lineage, "numbered", numbered)
    starts, edges = frames(spark, ["a", "b", None], [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", None), (None, "a"), ("c", "c")])
    got = sorted(map(tuple, lineage.downstream(edges, starts, hops=None).collect()))
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1)]


def test_names_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(lineage.F, "xxhash64", lambda *c: F.length(c[0]).cast("bigint"))
    starts, edges = frames(spark, ["a", "bb"], [("a", "bb"), ("bb", "cc"), ("dd", "a")])
    got = sorted(map(tuple, lineage.downstream(edges, starts, hops=None).collect()))
    assert got == [("a", "bb", 1), ("a", "cc", 2), ("bb", "cc", 1)]


def test_ends_are_grouped_without_a_join_of_links(spark, monkeypatch):
    plans, write = {}, graph.cut

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(graph, "cut", seen)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        links = [(1, 5), (2, 5), (3, 5), (3, 6), (5, 7), (5, 8), (6, 8), (4, 9)]
        links, weights = graph.reduced(spark.createDataFrame(links, "src bigint, dst bigint"))
        assert sorted(map(tuple, links.collect())) == [(1, 5), (3, 5), (3, 6), (5, 7), (5, 8), (6, 8)]
        assert [tuple(r) for r in weights.collect()] == [(1, 2)]
        assert plans["sinks"].count("SortMergeJoin") == 1 and "SortMergeJoin" not in plans["neighbours"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
