"""Catalogue, freshness and risk."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import catalog, freshness, pipeline, risk


def test_registry(spark):
    tables = spark.createDataFrame(
        [("taxi", "a", "t1"), ("taxi", "b", "t1"), ("taxi_pipeline", "a", "t1"), ("taxi", "a", "sqlite_stat1")],
        "domain string, instance string, table string",
    )
    reg = catalog.build_registry(tables)
    assert {(r.urn, r.instance, r.copies, r.status) for r in reg.collect()} == {
        ("urn:li:dataset:(urn:li:dataPlatform:sqlite,taxi.t1,PROD)", "b", 2, "AVAILABLE"),
        ("urn:li:dataset:(urn:li:dataPlatform:sqlite,taxi_pipeline.t1,PROD)", "a", 1, "AVAILABLE"),
    }
    assert [r.table for r in catalog.find_datasets(reg, "sqlite", "taxi").collect()] == ["t1"]
    assert catalog.find_datasets(reg, "postgres", "taxi").isEmpty()


def test_schema_rows(spark):
    rows = catalog.columns_of(spark.range(1).withColumn("v", F.lit("x")), "t").collect()
    assert [tuple(r) for r in rows] == [("t", 0, "id", "bigint"), ("t", 1, "v", "string")]


@pytest.mark.parametrize("text", ["DROP TABLE t", "insert into t select 1", "", "CREATE VIEW v AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "set x=1", "-- x\nDELETE FROM t",
    "WITH a AS (SELECT 1 AS x) INSERT /* c */ INTO t SELECT x FROM a", "WITH a AS (SELECT 1 AS x) DELETE FROM t WHERE x IN (SELECT x FROM a)",
    "WITH a AS (SELECT 1 AS x) UPDATE t SET x = 2", "FROM t INSERT INTO u SELECT * INSERT INTO v SELECT *",
    "WITH a AS (SELECT 1 AS x) MERGE INTO t USING a ON t.x = a.x WHEN MATCHED THEN DELETE", "SELECT TRANSFORM (x) USING 'cat' FROM t"])
def test_audit_sql_refuses_commands(spark, text):
    with pytest.raises(ValueError):
        catalog.audit_sql(spark, {}, text)


def test_audit_sql_reads(spark):
    tables = {"audited": spark.range(5)}
    assert catalog.audit_sql(spark, tables, " select count(*) AS n FROM audited ").first().n == 5
    assert catalog.audit_sql(spark, tables, "WITH a AS (SELECT id FROM audited) SELECT max(id) AS m FROM a").first().m == 4
    with pytest.raises(Exception):
        catalog.audit_sql(spark, tables, "SELECT 1; DROP TABLE x")
    for text in ("(SELECT 1 AS n)", "-- a note\nSELECT 1 AS n", "SELECT length('insert into') - 10 AS n", "/* x */ SELECT 1 AS n;"):
        assert catalog.audit_sql(spark, tables, text).first().n == 1
    assert catalog.audit_sql(spark, tables, "DESCRIBE audited").first().col_name == "id"


@pytest.mark.parametrize("text", [
    "EXECUTE IMMEDIATE 'CREATE TABLE evil USING parquet AS SELECT 1 AS x'", "EXECUTE IMMEDIATE 'SELECT 1'",
    "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT try_reflect('a', 'b')",
    "SELECT 1 FROM audited WHERE id IN (SELECT length(java_method('java.lang.System', 'getProperty', 'user.dir')))",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM hidden", "SELECT * FROM default.audited", "SELECT (SELECT max(id) FROM hidden)",
    "WITH hidden AS (SELECT 1 AS id) SELECT * FROM hidden", "SELECT plus_one(id) FROM audited", "SELECT * FROM IDENTIFIER('hidden')",
    "SELECT IDENTIFIER('reflect')('java.util.UUID', 'randomUUID')", "SELECT input_file_name()", "SELECT raise_error('x')", "BEGIN SELECT 1; END",
    "TABLE hidden", "DESCRIBE hidden", "DESCRIBE QUERY SELECT * FROM hidden", "EXPLAIN SELECT 1", "SHOW TABLES", "CACHE TABLE audited", "SELECT current_user()",
    "SELECT /*+ BROADCAST(audited) */ * FROM hidden",
    "SELECT * FROM VALUES (reflect('java.util.UUID', 'randomUUID')) AS t(x)", "SELECT exists(array(1), x -> reflect('java.util.UUID', 'randomUUID') = '')",
    "SELECT * FROM audited LATERAL VIEW explode(split(reflect('java.util.UUID', 'randomUUID'), '-')) t AS x",
])
def test_audit_sql_refuses_what_is_not_listed(spark, text):
    spark.range(3).createOrReplaceTempView("hidden")
    spark.udf.register("plus_one", lambda x: x + 1, "bigint")
    with pytest.raises(ValueError):
        catalog.audit_sql(spark, {"audited": spark.range(5)}, text)


@pytest.mark.parametrize("text", [
    "SELECT a.id % 2 AS odd, count(*) AS n, avg(b.id) AS m FROM audited a JOIN audited b USING (id) GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 3",
    "WITH x AS (SELECT id FROM audited), y AS (SELECT max(id) AS m FROM x) SELECT x.id FROM x, y WHERE x.id < y.m",
    "SELECT id, row_number() OVER (PARTITION BY id % 2 ORDER BY id) AS k FROM audited", "SELECT id, sum(id) OVER w AS s FROM audited WINDOW w AS (ORDER BY id)",
    "SELECT id FROM audited WHERE id IN (SELECT max(id) FROM audited) UNION ALL SELECT 7", "SELECT id FROM audited EXCEPT SELECT 1", "SELECT DISTINCT upper(cast(id AS string)) AS t FROM AUDITED",
    "SELECT CASE WHEN id BETWEEN 1 AND 2 THEN 'a' END AS c, transform(array(id), x -> x + 1) AS l FROM audited OFFSET 1", "SELECT * FROM VALUES (1, 'a') AS t(k, v)",
    "SELECT id, x FROM audited LATERAL VIEW explode(array(1, 2)) t AS x", "SELECT * FROM range(3)", "SELECT id FROM audited a WHERE EXISTS (SELECT 1 FROM audited b WHERE b.id = a.id + 1)",
    "SELECT * FROM (SELECT id, id % 2 AS k FROM audited) PIVOT (sum(id) FOR k IN (0, 1))", "SELECT id, count(*) AS n FROM audited GROUP BY CUBE (id)",
    "DESCRIBE QUERY SELECT id FROM audited", "DESC audited", "TABLE audited", "SELECT id::string AS t, current_date() >= date'2020-01-01' AS d, extract(year FROM date'2020-01-01') AS y FROM audited",
])
def test_audit_sql_runs_queries(spark, text):
    assert catalog.audit_sql(spark, {"audited": spark.range(5)}, text).count() > 0


def test_audit_sql_leaves_the_views_of_the_caller(spark):
    spark.range(2).createOrReplaceTempView("audited")
    got = catalog.audit_sql(spark, {"audited": spark.range(5), "audited_2": spark.range(1)}, "SELECT count(*) AS n FROM audited")
    assert spark.table("audited").count() == 2 and got.first().n == 5
    assert not spark.catalog.tableExists("audited_2")
    spark.catalog.dropTempView("audited")


def test_freshness_of_numbers_texts_and_files(spark, tmp_path):
    ms = freshness.last_event_ts(spark.createDataFrame([(1700000000,), (5,)], "updated_at bigint")).first()
    assert (ms.time_col, ms.last_ts_ms) == ("updated_at", 1700000000000)
    text = spark.createDataFrame([("2024-01-30T12:00:00Z",), ("junk",), (None,)], "created string")
    got = freshness.freshness(text, "2024-01-31T13:00:00Z").first()
    assert (got.hours_stale, got.is_stale, got.source) == (25.0, True, "column")
    assert freshness.freshness(text, dt.datetime(2024, 1, 31, 12)).first().is_stale is False
    spark.range(3).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    got = freshness.freshness(plain, "2100-01-01", files=plain).first()
    assert got.source == "file" and got.last_ts_ms > 1_600_000_000_000 and got.is_stale
    assert freshness.freshness(plain, "2100-01-01").first().hours_stale is None


def test_missing_days(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-04",), (None,)], "d string")
    assert sorted(str(r.day) for r in freshness.missing_days(days, "d").collect()) == ["2024-01-02", "2024-01-03"]
    assert freshness.missing_days(days.filter("d is null"), "d").isEmpty()


def test_trips_without_a_dropoff(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "1.5", "8"), (None, "1", "8"), ("2024-01-01 11:00:00", "", "8"), ("2024-01-02", "2", "-1")],
        "Lpep_Pickup_Datetime string, trip_distance string, fare_amount string",
    )
    out = pipeline.stage_trips(df).collect()
    assert [(str(r.trip_date), r.trip_duration_min, r.pipeline_status) for r in out] == [("2024-01-01", None, "staged")]
    with pytest.raises(ValueError):
        pipeline.stage_trips(df.drop("Lpep_Pickup_Datetime"))


STANDARD = [(True, 9.6, 0.5, 0.9, True), (True, 0.0, 0.0, 0.4, False), (False, 4.8, 0.333, 0.27, False), (True, 500.0, 1.0, 1.0, True), (None, None, None, 0.0, False)]


def test_standard_risk(spark):
    df = spark.createDataFrame([r[:3] for r in STANDARD], "has_pii boolean, hours_stale double, centrality double")
    got = [(r.risk_score, r.is_high_risk) for r in risk.risk_score(df).collect()]
    assert got == [r[3:] for r in STANDARD]


def test_weighted_risk(spark):
    df = spark.createDataFrame([(True, 25.0, 0.5, True), (False, 24.0, 0.0, False)], "has_pii boolean, hours_stale double, centrality double, is_orphan boolean")
    got = [(r.risk_score, r.has_freshness_issue) for r in risk.risk_score_weighted(df).collect()]
    assert got == [(0.9, True), (0.0, False)]


def test_context(spark, tmp_path):
    registry = catalog.detect_pii_columns(
        spark.createDataFrame([("u1", "t1", ["name", "x"]), ("u2", "t2", ["x"])], "urn string, table string, columns array<string>")
    )
    edges = spark.createDataFrame([("u1", "u2"), ("u1", "u3")], "src string, dst string")
    fresh = spark.createDataFrame([("u1", 48.0, True)], "dataset string, hours_stale double, is_stale boolean")
    central = spark.createDataFrame([("u1", 0.5)], "id string, centrality double")
    found = spark.createDataFrame(
        [("u1", "x", None, "negative", 1, 10, 10.0, -1.0, None, None, None)],
        "dataset string, column string, column_2 string, issue string, bad_rows bigint, total_rows bigint, pct double, min_value double, low double, high double, parsed_share double",
    )
    context = risk.governance_context(registry, edges, fresh, central, found)
    risk.write_context(context, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out/datasets").glob("*.json")) for x in f.read_text().splitlines()]
    first, second = sorted(lines, key=lambda x: x["urn"])
    assert first["risk_score"] == 0.9 and first["is_high_risk"] and first["downstream_count"] == 2
    assert first["statistical_profile"][0]["issue"] == "negative" and first["pii_columns"] == ["name"]
    assert second["risk_score"] == 0.0 and second["statistical_profile"] == [] and second["downstream_count"] == 0
    scores = risk.score_all(registry, fresh, central)
    assert tuple(risk.risk_summary(scores).first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        risk.score_all(registry, fresh, central, formula="other")


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", 1.5, 8.0), ("2024-01-01 10:00:00", float("inf"), 8.0), ("2024-01-01 10:00:00", float("nan"), 8.0)],
        "pickup_datetime string, trip_distance double, fare_amount double",
    )
    df.write.parquet(str(tmp_path / "trips"))
    staged = pipeline.stage_trips(spark.read.parquet(str(tmp_path / "trips")))
    assert staged.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(trip_distance,0.0)" in plan and "IsNotNull(pickup_datetime)" in plan
