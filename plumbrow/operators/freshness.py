"""Freshness: last event, hours behind, lag between stages, missing days, empty loads.

"Now" is always an argument. No operator reads a clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.functions import casts, names
from plumbrow.sources.shared import cut

# Name parts that mark a time column, hours after which a dataset is stale.
TIME_KEYWORDS = ("time", "date", "created", "updated", "pickup")
SLA_HOURS = 24.0


def time_column(df: DataFrame) -> str | None:
    """The first column with a time-like name."""
    return next((c for c in df.columns if names.name_has(c, TIME_KEYWORDS)), None)


def _epoch_ms(as_of: str | datetime) -> int:
    t = datetime.fromisoformat(as_of.replace("Z", "+00:00")) if isinstance(as_of, str) else as_of
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    return round(t.timestamp() * 1000)


def _last_ms(df: DataFrame, time_col: str) -> str:
    c, dtype = casts.quote(time_col), casts.field_of(df.schema, time_col).dataType
    if casts.is_temporal(dtype):  # one conversion of the result instead of one per row
        return casts.to_epoch_ms(f"max({c})", dtype)
    ms = casts.to_epoch_ms(c, dtype)
    return f"max({ms})" if ms else "CAST(NULL AS bigint)"


def last_event_ts(
    df: DataFrame, time_col: str | None = None, name: str = "table", by: str | None = None
) -> DataFrame:
    """``dataset, time_col, last_ts_ms``: the latest time in the first time column.

    A column that holds no time, or none at all, gives NULL.
    """
    time_col = time_col or time_column(df)
    last = F.expr(_last_ms(df, time_col) if time_col else "CAST(NULL AS bigint)").alias("last_ts_ms")
    grouped = df.groupBy(F.col(by).alias("dataset")) if by else df.groupBy()
    out = grouped.agg(last)
    if not by:
        out = out.withColumn("dataset", F.lit(name))
    return out.select("dataset", F.lit(time_col).cast("string").alias("time_col"), "last_ts_ms")


def file_mtime_ms(df: DataFrame, name: str = "table") -> DataFrame:
    """``dataset, last_ts_ms``: the latest modification time of the files under ``df``."""
    mtime = F.unix_millis(F.max("_metadata.file_modification_time"))
    return df.agg(mtime.alias("last_ts_ms")).select(F.lit(name).alias("dataset"), "last_ts_ms")


def _stale(last_ms: Column, as_of: str | datetime, sla_hours: float) -> tuple[Column, Column]:
    hours = (F.lit(_epoch_ms(as_of)) - last_ms) / F.lit(3_600_000.0)
    return hours, F.coalesce(hours > sla_hours, F.lit(False))


def freshness(
    df: DataFrame,
    as_of: str | datetime,
    sla_hours: float = SLA_HOURS,
    time_col: str | None = None,
    name: str = "table",
    by: str | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """``dataset, time_col, last_ts_ms, source, hours_stale, is_stale``.

    ``files`` (the table as read from storage) stands in with its file times for a dataset whose
    time column gives nothing; it is one extra row, joined by dataset name.
    """
    out = last_event_ts(df, time_col, name, by).withColumn("source", F.lit("column"))
    if files is not None:
        fallback = file_mtime_ms(files, name).withColumnRenamed("last_ts_ms", "file_ms")
        out = out.join(fallback, "dataset", "left").select(
            "dataset", "time_col",
            F.coalesce("last_ts_ms", "file_ms").alias("last_ts_ms"),
            F.when(F.col("last_ts_ms").isNull(), F.lit("file")).otherwise(F.col("source")).alias("source"),
        )
    hours, stale = _stale(F.col("last_ts_ms"), as_of, sla_hours)
    return out.withColumns({"hours_stale": hours, "is_stale": stale})


def _last_day(df: DataFrame, day_col: str) -> Column:
    return F.max(F.expr(casts.to_day(casts.quote(day_col), casts.field_of(df.schema, day_col).dataType)))


def stage_lag(stages: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Days by which each stage ``(name, table, date column)`` lies behind the first one.

    Each stage becomes one row, and the rows meet in one aggregate; there are as many as stages.
    """
    rows = [
        df.agg(_last_day(df, day).alias("last_day")).select(
            F.lit(i).alias("position"), F.lit(name).alias("stage"), "last_day"
        )
        for i, (name, df, day) in enumerate(stages)
    ]
    first = F.max(F.when(F.col("position") == 0, F.col("last_day"))).alias("first_day")
    return (
        reduce(DataFrame.unionByName, rows)
        .agg(first, F.collect_list(F.struct("position", "stage", "last_day")).alias("stages"))
        .select("first_day", F.inline("stages"))
        .select("position", "stage", "last_day", F.datediff("first_day", "last_day").alias("lag_days"))
    )


def missing_days(df: DataFrame, day_col: str, calendar: DataFrame | None = None) -> DataFrame:
    """Days without any row, against ``calendar(day)`` or every day from the first to the last.

    Days are made distinct in each task before anything is shuffled.
    """
    day = F.expr(casts.to_day(casts.quote(day_col), casts.field_of(df.schema, day_col).dataType))
    present = df.select(day.alias("day")).filter("day is not null").distinct()
    if calendar is None:
        present = cut(present, "days")  # read twice below, and tiny next to the table
        span = present.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null")
        calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    else:
        calendar = calendar.select(F.col("day").cast("date").alias("day")).distinct()
    return calendar.join(present, "day", "left_anti")


def empty_loads(df: DataFrame, count_col: str) -> DataFrame:
    """Rows of a summary whose row count says that nothing was loaded."""
    return df.filter(F.col(count_col) == 0)
