"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from plumbrow.plans import queries as registered
from tests.compare import differences

QUERIES = entry_points.queries()
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in registered.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registered.QUERIES) - set(ORACLES) == {"file_freshness"}


def test_file_times_are_those_of_the_files(spark, sf_dir):
    import os

    got = {r.dataset: r.last_ts_ms for r in QUERIES["file_freshness"](spark, sf_dir).collect()}
    assert len(got) == 14
    for table, ms in got.items():
        assert abs(ms - os.stat(f"{sf_dir}/{table}.parquet").st_mtime * 1000) < 1000


def test_entry_finds_defects(spark):
    assert entry_points.entry(spark).count() > 0


def test_the_stream_graph_is_within_the_steps_of_its_sql(spark):
    from plumbrow.operators import lineage
    from plumbrow.plans import inputs, sql
    from tests.compare import TESTDATA

    sf = f"{TESTDATA}/sf0.01"
    edges = inputs.stream_edges(spark, sf)
    far = lineage.downstream(edges, edges.selectExpr("src AS id"), hops=None).selectExpr("max(distance)").first()[0]
    assert 1 < far < sql.STEPS
    assert inputs.table(spark, sf, "events").filter("get_json_object(props, '$.k') IS NULL").isEmpty()  # each event is a link
    roles = QUERIES["lineage_node_roles"](spark, sf).selectExpr(
        *(f"count_if({c}) AS {c}" for c in ("is_root", "is_sink", "is_isolated", "is_orphan"))
    )
    assert all(n > 0 for n in roles.first())
