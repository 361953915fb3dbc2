import datetime as dt
import random

from pyspark.sql import functions as F

from plumbrow.functions import casts
from plumbrow.operators import profile as p
from plumbrow.plans import inputs


def found(df):
    return {(r.dataset, r.column, r.column_2, r.issue): (r.bad_rows, r.total_rows, r.pct, r.min_value) for r in df.collect()}


def test_every_kind_of_finding(spark):
    rows = [
        ("Ann", "-5.5", "30", "2024-01-02", "2024-01-01"),
        ("", "7", "-1", "2024-01-02", "2024-01-03"),
        ("NULL", "abc", "121", "2024-01-02", None),
        (None, "-9", "120", "2024-01-05", "2024-01-04 23:00:00"),
    ]
    df = spark.createDataFrame(rows, "name string, amount string, age string, start_date string, end_date string")
    assert found(p.profile(df, "t")) == {
        ("t", "name", None, "null_or_blank"): (3, 4, 75.0, None),
        ("t", "end_date", None, "null_or_blank"): (1, 4, 25.0, None),
        ("t", "amount", None, "negative"): (2, 4, 50.0, -9.0),
        ("t", "age", None, "negative"): (1, 4, 25.0, -1.0),
        ("t", "age", None, "invalid_age_range"): (2, 4, 50.0, None),
        ("t", "start_date", "end_date", "date_inversion"): (2, 4, 50.0, None),
    }


def test_empty_table_has_no_findings(spark):
    df = spark.createDataFrame([], "name string, age int")
    assert p.profile(df, "t").count() == 0


def test_a_name_that_contains_a_keyword_is_not_enough(spark):
    rows = [("Male", "2024-01-31", 5, 200)] * 20
    df = spark.createDataFrame(rows, "gender string, visit_date string, extended int, page_id int")
    assert found(p.profile(df, "t")) == {}
    loose = found(p.profile(df, "t", mode=casts.COMPAT))
    assert loose[("t", "gender", "visit_date", "date_inversion")][0] == 20
    assert loose[("t", "page_id", None, "invalid_age_range")][0] == 20


def test_a_mostly_temporal_text_column_counts(spark):
    rows = [("2024-01-02", "2024-01-01")] * 97 + [("soon", "2024-01-01")] * 3
    df = spark.createDataFrame(rows, "start_date string, end_date string")
    assert found(p.profile(df, "t"))[("t", "start_date", "end_date", "date_inversion")][0] == 97
    rows = [("2024-01-02", "2024-01-01")] * 90 + [("soon", "2024-01-01")] * 10
    df = spark.createDataFrame(rows, "start_date string, end_date string")
    assert found(p.profile(df, "t"))[("t", "start_date", "end_date", "date_inversion")][0] == 90
    assert p.profile(df, "t").first().parsed_share == 0.9


def test_a_time_is_not_after_its_own_day(spark):
    rows = [(dt.datetime(2024, 1, 1, 12), dt.date(2024, 1, 1)), (dt.datetime(2024, 1, 2), dt.date(2024, 1, 1))]
    df = spark.createDataFrame(rows, "pickup_time timestamp, trip_date date")
    assert found(p.profile(df, "t"))[("t", "pickup_time", "trip_date", "date_inversion")][0] == 1


def test_arrays_and_odd_names(spark):
    df = spark.createDataFrame([([1.0], True, -1), (None, None, 2)], "`a b` array<double>, flag boolean, `x``y` int")
    assert found(p.profile(df, "it's")) == {
        ("it's", "a b", None, "null_or_blank"): (1, 2, 50.0, None),
        ("it's", "flag", None, "null_or_blank"): (1, 2, 50.0, None),
        ("it's", "x`y", None, "negative"): (1, 2, 50.0, -1.0),
    }


def test_a_wide_table(spark):
    n = 300
    df = spark.range(10).select(*[(F.col("id") - i % 7).alias(f"c{i}") for i in range(n)])
    got = found(p.profile(df, "wide"))
    assert got == {
        ("wide", f"c{i}", None, "negative"): (i % 7, 10, i % 7 * 10.0, float(-(i % 7))) for i in range(n) if i % 7
    }


def test_a_wide_table_is_scanned_once(spark, tmp_path):
    """300 columns, 40 of them dates: all pairs are compared in the one scan."""
    names = [f"c{i}" for i in range(260)] + [f"date_{i}" for i in range(40)]
    path = str(tmp_path / "wide")
    spark.range(3).select(
        *[F.lit(1).alias(n) if n[0] == "c" else F.lit(f"2024-01-{int(n[5:]) % 28 + 1:02d}").alias(n) for n in names]
    ).write.parquet(path)
    df = p.profile(spark.read.parquet(path), "wide")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = found(df)
    days = [i % 28 for i in range(40)]
    assert len(got) == sum(days[i] > days[j] for i in range(40) for j in range(i + 1, 40))


def test_inversions_show_however_few_values_parse(spark):
    rows = [("2024-01-02", "2024-01-01")] + [("junk", "x")] * 9
    r = p.profile(spark.createDataFrame(rows, "start_date string, end_date string"), "t").first()
    assert (r.issue, r.bad_rows, r.parsed_share) == ("date_inversion", 1, 0.1)


def test_by_dataset_is_the_same_as_one_by_one(spark):
    rnd = random.Random(3)
    # One dataset holds a third of the rows.
    rows = [
        (rnd.choice(["hot"] * 10 + [f"d{i}" for i in range(20)]), rnd.choice([None, "", "x", "-4"]), rnd.randint(-5, 130))
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "dataset string, note string, age int")
    together = found(p.profile(df, by="dataset"))
    for name in ("hot", "d0", "d13"):
        alone = found(p.profile(df.filter(F.col("dataset") == name).drop("dataset"), name))
        assert alone == {k: v for k, v in together.items() if k[0] == name}


def test_rows_in_another_order_change_nothing(spark, sf_dir):
    df = inputs.patients(spark, sf_dir)
    assert found(p.profile(df)) == found(p.profile(df.repartition(7).orderBy(F.desc("doctor"))))


def test_declared_types_do_not_look_into_text(spark):
    df = spark.createDataFrame([("-1", -1, "NULL"), ("", -2, "x")], "a string, b int, c string")
    assert found(p.declared_profile(df, "t")) == {
        ("t", "a", None, "null_or_blank"): (1, 2, 50.0, None),
        ("t", "b", None, "negative"): (2, 2, 100.0, -2.0),
    }


def test_summary_fills_missing_keys(spark):
    df = spark.createDataFrame([("u1", "c", "negative"), ("u1", "c", "negative"), (None, None, None)], "urn string, column string, entry_type string")
    got = {tuple(r) for r in p.summarize_anomalies(df).collect()}
    assert got == {("u1", "c", "negative", 2), ("unknown_dataset", "unknown_column", "Quality Variance", 1)}


def test_one_pass_over_the_table(spark, sf_dir):
    plan = p.profile(inputs.patients(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
