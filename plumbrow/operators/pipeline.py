"""Stages of the two demo pipelines (patients and trips) and the audit of any chain of stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions import casts

# Status text, cleaned columns, names a trip table may use for its two times.
STAGED = "staged"
PATIENT_CLEAN = {
    "gender": "gender_clean",
    "blood_type": "blood_type_clean",
    "medical_condition": "condition_clean",
    "admission_type": "admission_type_clean",
    "test_results": "test_results_clean",
}
PICKUP_CANDIDATES = (
    "tpep_pickup_datetime",
    "pickup_datetime",
    "lpep_pickup_datetime",
    "Trip_Pickup_DateTime",
)
DROPOFF_CANDIDATES = (
    "tpep_dropoff_datetime",
    "dropoff_datetime",
    "lpep_dropoff_datetime",
    "Trip_Dropoff_DateTime",
)


def _num(df: DataFrame, name: str, mode: str) -> Column:
    return F.expr(casts.to_double(casts.quote(name), casts.field_of(df.schema, name).dataType, mode))


def _seconds(df: DataFrame, start: str, end: str) -> Column:
    a, b = (casts.to_timestamp(casts.quote(c), casts.field_of(df.schema, c).dataType) for c in (start, end))
    return F.expr(casts.seconds_between(a, b))


def _day(df: DataFrame, name: str) -> Column:
    return F.expr(casts.to_day(casts.quote(name), casts.field_of(df.schema, name).dataType))


def stage_clean(
    df: DataFrame, cols: Mapping[str, str] = PATIENT_CLEAN, status: str = STAGED
) -> DataFrame:
    """All columns, plus trimmed lower-case copies of some, plus the status. No row is dropped."""
    clean = [F.lower(F.trim(c)).alias(out) for c, out in cols.items()]
    return df.select("*", *clean, F.lit(status).alias("pipeline_status"))


def mart_billing(df: DataFrame, mode: str = casts.STRICT) -> DataFrame:
    days = _seconds(df, "date_of_admission", "discharge_date") / 86400.0
    return df.select(
        "name", "hospital", "insurance_provider",
        F.col("admission_type_clean").alias("admission_type"),
        _num(df, "billing_amount", mode).alias("billing_amount"),
        "date_of_admission", "discharge_date",
        F.round(days, 1).alias("length_of_stay_days"),
        "medication", "pipeline_status",
    )


def mart_demographics(df: DataFrame, mode: str = casts.STRICT) -> DataFrame:
    return df.select(
        "name",
        F.expr(casts.to_int("age", casts.field_of(df.schema, "age").dataType, mode)).alias("age"),
        F.col("gender_clean").alias("gender"),
        F.col("blood_type_clean").alias("blood_type"),
        F.col("condition_clean").alias("medical_condition"),
        "hospital",
        F.col("test_results_clean").alias("test_results"),
        "pipeline_status",
    )


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that the table has, whatever its case."""
    have = {c.lower().strip(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def stage_trips(
    df: DataFrame,
    pickup: Sequence[str] = PICKUP_CANDIDATES,
    dropoff: Sequence[str] = DROPOFF_CANDIDATES,
    mode: str = casts.STRICT,
    status: str = STAGED,
) -> DataFrame:
    """Trips with a pickup, a distance and a fare, plus day, minutes (NULL without a dropoff) and status."""
    start, end = pick_column(df, pickup), pick_column(df, dropoff)
    if start is None:
        raise ValueError(f"no pickup column; expected one of {list(pickup)}")
    minutes = F.lit(None).cast("double")
    if end is not None:
        minutes = F.round(_seconds(df, start, end) / 60.0, 1)
    kept = df.filter(F.col(start).isNotNull())
    for c in ("trip_distance", "fare_amount"):
        kept = kept.filter(casts.is_positive(c, casts.field_of(df.schema, c).dataType, mode))
    return kept.select(
        "*",
        _day(df, start).alias("trip_date"),
        minutes.alias("trip_duration_min"),
        F.lit(status).alias("pipeline_status"),
    )


def daily_summary(df: DataFrame, mode: str = casts.STRICT, ordered: bool = True) -> DataFrame:
    """One row per day: trips, two totals, four averages.

    Counts and sums are formed in each task first, so a day with a third of all trips is one row
    per task in the shuffle. Only the rows per day are sorted.
    """

    def num(c: str) -> Column:
        return _num(df, c, mode)

    out = df.groupBy("trip_date").agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.round(F.sum(num("fare_amount")), 2).alias("total_fare"),
        F.round(F.sum(num("total_amount")), 2).alias("total_revenue"),
        F.round(F.avg(num("fare_amount")), 2).alias("avg_fare"),
        F.round(F.avg(num("trip_distance")), 2).alias("avg_distance"),
        F.round(F.avg(num("passenger_count")), 1).alias("avg_passengers"),
        F.round(F.avg("trip_duration_min"), 1).alias("avg_duration_min"),
    )
    return out.orderBy("trip_date") if ordered else out


def propagation(stages: Sequence[tuple[str, DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """``stage, defect, bad_rows``: the same defects counted at each stage, one pass per stage."""
    parts = []
    for stage, df, predicates in stages:
        counted = df.agg(*[F.count_if(p).alias(d) for d, p in predicates.items()])
        rows = [F.struct(F.lit(d).alias("defect"), F.col(d).alias("bad_rows")) for d in predicates]
        parts.append(counted.select(F.lit(stage).alias("stage"), F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def stage_audit(stages: Sequence[tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """``stage, row_count, last_day, empty_days`` of ``(name, table, date column, count column)``.

    ``empty_days`` is NULL for a stage without a count column.
    """
    parts = []
    for stage, df, day, count_col in stages:
        empty = F.count_if(F.col(count_col) == 0) if count_col else F.lit(None).cast("bigint")
        last = F.max(_day(df, day))
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("row_count"), last.alias("last_day"), empty.alias("empty_days")
            ).select(F.lit(stage).alias("stage"), "row_count", "last_day", "empty_days")
        )
    return reduce(DataFrame.unionByName, parts)
