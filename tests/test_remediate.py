from pyspark.sql import functions as F

from plumbrow.operators import pipeline, profile as p, remediate as r
from plumbrow.plans import inputs
from tests.test_profile import found


def test_cleaned_table_has_no_such_defects_left(spark, sf_dir):
    df = inputs.patients(spark, sf_dir)
    before = found(p.profile(df))
    clean = r.remediate(df, p.profile(df))
    assert clean.columns == df.columns and clean.count() == df.count()
    left = found(p.profile(clean))
    assert {k[3] for k in before} == {p.NULL_OR_BLANK, p.NEGATIVE, p.INVALID_AGE, p.DATE_INVERSION}
    # Blank texts stay blank, and an impossible age becomes NULL: both only count as missing.
    assert {k[3] for k in left} == {p.NULL_OR_BLANK}


def test_script_builds_the_same_table(spark, sf_dir):
    df = inputs.patients(spark, sf_dir)
    found_ = p.profile(df)
    df.createOrReplaceTempView("script_source")
    script = r.fix_script(df, found_, "script_source")
    head, _, body = script.partition("CREATE OR REPLACE TABLE `cleaned_script_source` AS\n")
    assert "Corrected inverted date logic between 'date_of_admission' and 'discharge_date'" in head
    built = spark.sql(body.rstrip().rstrip(";"))
    want = r.remediate(df, found_)
    assert built.columns == want.columns
    assert built.exceptAll(want).isEmpty() and want.exceptAll(built).isEmpty()


def test_a_clean_table_stays_as_it_is(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert r.remediate(df, p.profile(df)).collect() == df.collect()
    assert "(none)" in r.fix_script(df, p.profile(df), "t")


def test_swap_keeps_nulls(spark):
    rows = [("2024-01-03", "2024-01-01"), ("2024-01-01", None), (None, "2024-01-01"), ("2024-01-01", "2024-01-02")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [tuple(x) for x in r.swap_dates(df, "a", "b").collect()] == [
        ("2024-01-01", "2024-01-03"), ("2024-01-01", None), (None, "2024-01-01"), ("2024-01-01", "2024-01-02"),
    ]


def test_pairs_follow_column_order(spark):
    df = spark.createDataFrame([("2024-01-03", "2024-01-02", "2024-01-01")], "start_a string, start_b string, end_c string")
    clean = r.remediate(df, p.profile(df)).first()
    assert tuple(clean) == ("2024-01-01", "2024-01-02", "2024-01-03")


def test_repairs_keep_types(spark):
    df = spark.createDataFrame(
        [(-5, -1.5, "-2", 150, None), (None, None, None, 30, None)],
        "qty int, price double, amount string, age int, title string",
    )
    clean = r.remediate(df, p.profile(df))
    assert clean.schema.simpleString() == df.schema.simpleString()
    # A column with a number defect is not filled as well.
    assert [tuple(x) for x in clean.collect()] == [(0, 0.0, "0", None, "UNKNOWN"), (None, None, None, 30, "UNKNOWN")]
    filled = r.fill_nulls(df)
    assert tuple(filled.collect()[1]) == (0, 0.0, "UNKNOWN", 30, "UNKNOWN")


def test_negative_amounts_are_dropped_and_missing_ones_kept(spark):
    df = spark.createDataFrame([("-1",), ("0",), (None,), ("5",)], "amount string")
    assert [x[0] for x in r.drop_invalid(df, "amount").collect()] == ["0", None, "5"]


ANOMALIES = "dataset string, column string, column_2 string, issue string, bad_rows bigint, total_rows bigint, pct double, min_value double"


def test_breaker_by_carried_columns(spark):
    found_ = spark.createDataFrame([("raw", "admission_type", None, p.NULL_OR_BLANK, 5, 100, 5.0, None)], ANOMALIES)
    edges = spark.createDataFrame([("raw", "staging"), ("staging", "billing"), ("staging", "people"), ("other", "far")], "src string, dst string")
    columns = spark.createDataFrame(
        [("staging", "admission_type"), ("billing", "admission"), ("people", "age"), ("far", "admission_type")],
        "dataset string, column string",
    )

    def status(**options):
        return {x.dataset: x.status for x in r.circuit_breaker(found_, edges, columns, **options).collect()}

    carried = {"staging": "PAUSED", "billing": "OPERATIONAL", "people": "OPERATIONAL", "far": "OPERATIONAL"}
    assert status() == carried
    renames = spark.createDataFrame([("billing", "admission", "admission_type")], "dataset string, column string, source_column string")
    assert status(renames=renames) == {**carried, "billing": "PAUSED"}
    assert set(status(threshold_pct=5.0).values()) == {"OPERATIONAL"}
    watch = spark.createDataFrame([("people", "admission_type", p.NULL_OR_BLANK)], "dataset string, column string, issue string")
    assert status(watch=watch) == {**carried, "staging": "OPERATIONAL", "people": "PAUSED"}


def test_breaker_follows_columns_from_table_to_table(spark):
    """Two renames in a row, a table that drops the column, a column renamed away, a cycle and a name with odd characters."""
    found_ = spark.createDataFrame([("raw", "amount", None, p.NEGATIVE, 1, 100, 1.0, -1.0)], ANOMALIES)
    chain = [("raw", "staging"), ("staging", "mart"), ("raw", "other"), ("other", "mart2"), ("staging", "swapped"), ("mart", "staging"), ("mart", 'o"dd, 1')]
    edges = spark.createDataFrame(chain, "src string, dst string")
    columns = spark.createDataFrame(
        [("raw", "amount"), ("staging", "amt"), ("mart", "billing"), ("other", "id"), ("mart2", "amount"), ("swapped", "amt"), ('o"dd, 1', "billing")],
        "dataset string, column string",
    )
    renames = [("staging", "amt", "amount"), ("mart", "billing", "amt"), ("swapped", "amt", "id")]
    renames = spark.createDataFrame(renames, "dataset string, column string, source_column string")
    got = {x.dataset: (x.status, x.defects) for x in r.circuit_breaker(found_, edges, columns, renames=renames).collect()}
    paused, running = ("PAUSED", 1), ("OPERATIONAL", 0)
    assert got == {"staging": paused, "mart": paused, 'o"dd, 1': paused, "other": running, "mart2": running, "swapped": running}


def test_selective_halting(spark, sf_dir):
    """Negative amounts reach the billing mart only, impossible ages the other one only."""
    raw = inputs.patients(spark, sf_dir)
    staged = pipeline.stage_clean(raw)
    billing, people = pipeline.mart_billing(staged), pipeline.mart_demographics(staged)
    n = raw.filter(F.col("billing_amount").try_cast("double") < 0).count()
    assert billing.filter("billing_amount < 0").count() == n > 0
    kinds = {k[3] for k in found(p.profile(people))}
    assert p.INVALID_AGE in kinds and ("people", "billing_amount") not in found(p.profile(people, "people"))


def test_report_tells_what_was_done(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, -1, 150)],
        "title string, city string, price double, start_date date, qty int, age int",
    )
    found_ = p.profile(df, "t")
    lines = {
        r.TEXT_LINE % "title", r.TEXT_LINE % "city", r.ZERO_LINE % "price", r.NEGATIVE_LINE % "qty",
        r.AGE_LINE % "age",
    }
    assert {x.line for x in r.fix_report(found_, df.schema).collect()} == lines
    script = r.fix_script(df, found_, "t")
    assert all(x in script for x in lines) and "start_date'" not in script
    by_name = {x.line for x in r.fix_report(found_).collect()}
    assert by_name == lines - {r.TEXT_LINE % "city"} | {r.ZERO_LINE % "city", r.ZERO_LINE % "start_date"}


def test_the_bounds_of_a_finding_decide_the_repair(spark):
    df = spark.createDataFrame([(500.0,), (-5.0,), (20.0,)], "temperature double")
    found = p.profile(df, "t", ranges={"temperature": (0, 50)})
    assert {x.issue: (x.low, x.high) for x in found.collect()} == {"negative": (None, None), "invalid_age_range": (0.0, 50.0)}
    assert [x[0] for x in r.remediate(df, found).collect()] == [None, None, 20.0]
    line = "Fixed invalid age range in column 'temperature'"
    assert [x.line for x in r.fix_report(found, df.schema).collect()] == [line]
    assert line in r.fix_script(df, found, "t") and "< 0.0 OR" in r.fix_script(df, found, "t")


def test_one_bad_row_in_many_pauses(spark):
    df = spark.range(100_000).selectExpr("CASE WHEN id = 7 THEN -1 ELSE 1 END AS amount")
    found = p.profile(df, "raw")
    assert found.first().pct == 0.0
    edges = spark.createDataFrame([("raw", "mart")], "src string, dst string")
    columns = spark.createDataFrame([("mart", "amount")], "dataset string, column string")
    got = r.circuit_breaker(found, edges, columns).first()
    assert (got.status, got.defects) == ("PAUSED", 1)


def test_columns_are_found_in_any_case(spark):
    df = spark.createDataFrame([(-1.0, None, "2024-01-02", "2024-01-01", 200)], "Fare double, Title string, Start_Date string, End_Date string, Age int")
    assert r.clip_negative(df, ["fare"]).first().Fare == 0.0 and r.fill_nulls(df, ["TITLE"]).first().Title == "UNKNOWN"
    assert r.null_out_of_range(df, {"age": (0, 120)}).first().Age is None and r.drop_invalid(df, "FARE").count() == 0
    assert r.swap_dates(df, "start_date", "end_date").first().Start_Date == "2024-01-01"
    assert {x.column for x in p.range_profile(df, {"fare": (0, 1)}).collect()} == {"Fare"}
    assert p.date_order_profile(df, [("start_date", "END_DATE")]).first().column_2 == "End_Date"
    trips = spark.createDataFrame([("2024-01-01 10:00:00", 2.0, 5.0)], "Pickup_DateTime string, Trip_Distance double, FARE_AMOUNT double")
    assert pipeline.stage_trips(trips).count() == 1


def test_each_dataset_is_repaired_as_if_alone(spark):
    """Null and clean datasets, repeated rows, a range in one dataset only, columns named like those the operator adds."""
    schema = "fixes string, amount double, age int, title string, start_a string, start_b string, end_c string, fixed_dataset int"
    rows = [
        ("a", -1.0, 150, None, "2024-01-03", "2024-01-02", "2024-01-01", 1), ("a", None, None, "x", "2024-01-01", None, "2024-01-02", None),
        ("b", None, 40, "x", "2024-01-01", "2024-01-03", "2024-01-02", 2), ("b", None, 40, "x", "2024-01-01", "2024-01-03", "2024-01-02", 2),
        ("b", 2.0, -3, "", None, None, None, -4), (None, -3.0, 130, None, "2024-01-02", "2024-01-01", None, 3),
        (None, 1.0, None, "y", None, None, None, 3), ("clean", 1.0, 5, "z", "2024-01-01", "2024-01-02", "2024-01-03", 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = r.remediate_datasets(df, p.profile(df, by="fixes"), "fixes")
    assert got.schema.simpleString() == df.schema.simpleString()
    want = None
    for name in ("a", "b", None, "clean"):
        part = df.filter(df["fixes"].eqNullSafe(F.lit(name)))
        found_ = p.profile(part, by="fixes").filter(F.col("column") != "fixes")
        part = r.remediate(part, found_)
        want = part if want is None else want.union(part)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert r.remediate_datasets(df.limit(0), p.profile(df.limit(0), by="fixes"), "fixes").count() == 0


def test_datasets_with_bounds_of_their_own(spark):
    df = spark.createDataFrame([("a", 5), ("a", -5), ("b", 5), ("b", -5), ("c", -5)], "d string, x int")
    cols = "dataset string, column string, column_2 string, issue string, low double, high double"
    found_ = spark.createDataFrame(
        [("a", "x", None, p.INVALID_AGE, 0.0, 10.0), ("b", "x", None, p.INVALID_AGE, -9.0, 3.0), ("c", "x", None, p.NEGATIVE, None, None)], cols
    )
    got = r.remediate_datasets(df, found_, "d").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 5), ("a", None), ("b", -5), ("b", None), ("c", 0)]
