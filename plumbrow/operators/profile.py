"""Defect profiles: missing values, negative numbers, values out of range, dates in the wrong order.

All checks of a table, however wide, are counted in one aggregate over one scan.
With ``by`` the same pass profiles many datasets held in one table: partial counts are formed in
each task, so a dataset with a third of the rows is no bottleneck.

Result: ``dataset, column, column_2, issue, bad_rows, total_rows, pct, min_value, low, high, parsed_share``,
one row per finding with ``bad_rows > 0``. ``pct`` is rounded for reading; decisions use the two counts.
``low`` and ``high`` are the bounds that a range check used. ``parsed_share`` tells, for dates held as
text, which part of the values that are not blank can be read as a time (the smaller one of a pair).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbrow.functions import casts, names

# The names of the issues, the name parts that mark a date column, the valid ages.
NULL_OR_BLANK = "null_or_blank"
NEGATIVE = "negative"
INVALID_AGE = "invalid_age_range"
DATE_INVERSION = "date_inversion"
BLANK_TEXTS = ("", "NULL")
DATE_KEYWORDS = ("date", "time", "created", "updated", "admission", "discharge", "start", "end")
AGE_KEYWORDS = ("age",)
AGE_RANGE = (0, 120)

FINDING = (
    "struct<column:string,column_2:string,issue:string,bad_rows:bigint,total_rows:bigint,"
    "pct:double,min_value:double,low:double,high:double,parsed_share:double>"
)


@dataclass(frozen=True)
class Check:
    """One rule on one column (or pair), as SQL: which rows break it, and what else to report."""

    column: str
    issue: str
    bad: str
    column_2: str | None = None
    value: str | None = None  # the smallest one is reported
    texts: tuple[str, ...] = ()  # text columns read as times, whose parsed share is reported
    low: float | None = None
    high: float | None = None


def _fields(df: DataFrame, skip: Iterable[str | None] = ()) -> list[T.StructField]:
    skip = set(skip)
    return [f for f in df.schema.fields if f.name not in skip]


def null_checks(fields: Sequence[T.StructField], blanks: Sequence[str] = BLANK_TEXTS) -> list[Check]:
    """Text can be missing in more ways than NULL; other types cannot."""
    listed = ", ".join(casts.literal(b) for b in blanks)
    out = []
    for f in fields:
        c = casts.quote(f.name)
        blank = f" OR {c} IN ({listed})" if casts.is_text(f.dataType) else ""
        out.append(Check(f.name, NULL_OR_BLANK, f"{c} IS NULL{blank}"))
    return out


def negative_checks(
    fields: Sequence[T.StructField], mode: str = casts.STRICT, declared: bool = False
) -> list[Check]:
    """``declared`` looks at numeric columns only, not at numbers held as text."""
    out = []
    for f in fields:
        if declared and not casts.is_numeric(f.dataType):
            continue
        x = casts.negative_part(casts.quote(f.name), f.dataType, mode)
        if x is not None:
            out.append(Check(f.name, NEGATIVE, f"({x}) IS NOT NULL", value=x))
    return out


def age_ranges(fields: Sequence[T.StructField], mode: str = casts.STRICT) -> dict[str, tuple]:
    """Columns named like an age. ``compat`` matches inside words too, so ``page_id`` counts."""
    match = names.TOKEN if mode == casts.STRICT else names.SUBSTRING
    return {f.name: AGE_RANGE for f in fields if names.name_has(f.name, AGE_KEYWORDS, match)}


def range_checks(
    fields: Sequence[T.StructField], ranges: Mapping[str, tuple], mode: str = casts.STRICT
) -> list[Check]:
    out = []
    for name, (lo, hi) in ranges.items():
        f = casts.field_of(fields, name)
        x = casts.to_double(casts.quote(f.name), f.dataType, mode)
        if x is not None:
            out.append(Check(f.name, INVALID_AGE, f"({x}) < {lo} OR ({x}) > {hi}", low=lo, high=hi))
    return out


def _later_as_stored(a: T.StructField, b: T.StructField) -> str | None:
    """``compat``: numbers compare as numbers, all else as text, and any text lies after any number."""
    ca, cb = casts.quote(a.name), casts.quote(b.name)
    num_a, num_b = casts.is_numeric(a.dataType), casts.is_numeric(b.dataType)
    if num_a and num_b:
        return f"{ca} > {cb}"
    if num_a:
        return None
    ta, tb = f"CAST({ca} AS string)", f"CAST({cb} AS string)"
    if num_b:
        return f"{ta} <> '' AND {cb} IS NOT NULL"
    return f"{ta} <> '' AND {tb} <> '' AND {ta} > {tb}"


def date_columns(fields: Sequence[T.StructField], mode: str = casts.STRICT) -> list[T.StructField]:
    """Columns with a date-like name, in order; ``strict`` leaves out those whose type holds no time."""

    def holds_time(t: T.DataType) -> bool:
        if casts.is_temporal(t) or casts.is_text(t):
            return True
        return mode == casts.COMPAT and casts.is_numeric(t)

    return [f for f in fields if names.name_has(f.name, DATE_KEYWORDS) and holds_time(f.dataType)]


def date_order_checks(
    fields: Sequence[T.StructField],
    pairs: Sequence[tuple[str, str]] | None = None,
    mode: str = casts.STRICT,
) -> list[Check]:
    if pairs is None:
        cols = [f.name for f in date_columns(fields, mode)]
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    out = []
    for a, b in pairs:
        fa, fb = casts.field_of(fields, a), casts.field_of(fields, b)
        a, b = fa.name, fb.name
        if mode == casts.COMPAT:
            bad, texts = _later_as_stored(fa, fb), ()
        else:
            bad = casts.is_later(casts.quote(a), fa.dataType, casts.quote(b), fb.dataType)
            texts = tuple(f.name for f in (fa, fb) if casts.is_text(f.dataType))
        if bad is not None:
            out.append(Check(a, DATE_INVERSION, bad, column_2=b, texts=texts))
    return out


def all_checks(
    fields: Sequence[T.StructField],
    mode: str = casts.STRICT,
    ranges: Mapping[str, tuple] | None = None,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> list[Check]:
    if ranges is None:
        ranges = age_ranges(fields, mode)
    return [
        *null_checks(fields),
        *negative_checks(fields, mode),
        *range_checks(fields, ranges, mode),
        *date_order_checks(fields, pairs, mode),
    ]


def count_checks(
    df: DataFrame, checks: Sequence[Check], name: str = "table", by: str | None = None
) -> DataFrame:
    """Count any list of checks over ``df``, in one aggregate; then one row per check that found something.

    An empty table has no findings.
    """
    checks = list(checks) or [Check("", "none", "false")]
    aggs = ["count(1) AS total_rows"]
    texts = sorted({t for c in checks for t in c.texts})
    for i, c in enumerate(checks):
        aggs.append(f"count(CASE WHEN {c.bad} THEN 1 END) AS bad_{i}")
        if c.value is not None:
            aggs.append(f"min({c.value}) AS min_{i}")
    for j, t in enumerate(texts):
        aggs.append(f"count(CASE WHEN trim({casts.quote(t)}) <> '' THEN 1 END) AS filled_{j}")
        aggs.append(f"count(try_cast({casts.quote(t)} AS timestamp)) AS parsed_{j}")
    keys = [F.col(casts.quote(by)).alias("dataset")] if by else []
    counted = df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])

    def number(x: float | None) -> str:
        return "CAST(NULL AS double)" if x is None else f"CAST('{x}' AS double)"

    def finding(i: int, c: Check) -> str:
        second = casts.literal(c.column_2) if c.column_2 else "CAST(NULL AS string)"
        least = f"CAST(min_{i} AS double)" if c.value is not None else "CAST(NULL AS double)"
        shares = [f"parsed_{j} / nullif(filled_{j}, 0)" for j in map(texts.index, c.texts)]
        parsed = {0: "CAST(NULL AS double)", 1: "".join(shares)}.get(len(shares), f"least({', '.join(shares)})")
        return (
            f"{casts.literal(c.column)}, {second}, {casts.literal(c.issue)}, CAST(bad_{i} AS bigint), {least}, "
            f"{number(c.low)}, {number(c.high)}, {parsed}"
        )

    rows = ", ".join(finding(i, c) for i, c in enumerate(checks))
    dataset = "dataset" if by else f"{casts.literal(name)} AS dataset"
    names_ = "column, column_2, issue, bad_rows, min_value, low, high, parsed"
    stacked = counted.selectExpr(dataset, "total_rows", f"stack({len(checks)}, {rows}) AS ({names_})")
    return stacked.filter("bad_rows > 0").selectExpr(
        "dataset", "column", "column_2", "issue", "bad_rows", "total_rows",
        "round(bad_rows / total_rows * 100D, 2) AS pct", "min_value", "low", "high",
        "round(parsed, 4) AS parsed_share",
    )


def null_profile(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Rows that are NULL, empty or the text ``NULL``, for every column."""
    return count_checks(df, null_checks(_fields(df, [by])), name, by)


def negative_profile(
    df: DataFrame, name: str = "table", by: str | None = None, mode: str = casts.STRICT
) -> DataFrame:
    """Negative numbers, also those held as text, with the smallest one."""
    return count_checks(df, negative_checks(_fields(df, [by]), mode), name, by)


def range_profile(
    df: DataFrame,
    ranges: Mapping[str, tuple] | None = None,
    name: str = "table",
    by: str | None = None,
    mode: str = casts.STRICT,
) -> DataFrame:
    """Values outside ``{column: (low, high)}``; by default the columns named like an age."""
    fields = _fields(df, [by])
    if ranges is None:
        ranges = age_ranges(fields, mode)
    return count_checks(df, range_checks(fields, ranges, mode), name, by)


def date_order_profile(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] | None = None,
    name: str = "table",
    by: str | None = None,
    mode: str = casts.STRICT,
) -> DataFrame:
    """Rows whose first date lies after the second, for every pair of date columns in order."""
    return count_checks(df, date_order_checks(_fields(df, [by]), pairs, mode), name, by)


def declared_profile(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """The variant that trusts declared types: NULL or empty, and negatives of numeric columns."""
    fields = _fields(df, [by])
    checks = [*null_checks(fields, blanks=("",)), *negative_checks(fields, declared=True)]
    return count_checks(df, checks, name, by)


def profile(
    df: DataFrame,
    name: str = "table",
    by: str | None = None,
    mode: str = casts.STRICT,
    ranges: Mapping[str, tuple] | None = None,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Everything above in one pass."""
    return count_checks(df, all_checks(_fields(df, [by]), mode, ranges, pairs), name, by)


def defects(df: DataFrame, name: str = "table", mode: str = casts.STRICT) -> DataFrame:
    """One row per defect instead of counts: ``dataset, column, type``. A map over the rows, no shuffle."""
    hits = ", ".join(
        f"CASE WHEN {c.bad} THEN struct({casts.literal(c.column)} AS column, {casts.literal(c.issue)} AS type) END"
        for c in all_checks(_fields(df), mode)
    )
    found = df.selectExpr(f"explode(filter(array({hits}), h -> h IS NOT NULL)) AS h")
    return found.selectExpr(f"{casts.literal(name)} AS dataset", "h.column", "h.type")


# Labels for findings that lack a key.
UNKNOWN_DATASET = "unknown_dataset"
UNKNOWN_COLUMN = "unknown_column"
UNKNOWN_TYPE = "Quality Variance"


def summarize_anomalies(found: DataFrame) -> DataFrame:
    """Occurrences by dataset, column and type, whichever of the usual key names ``found`` has."""

    def first_of(keys: Sequence[str], label: str) -> Column:
        return F.coalesce(*[F.col(k) for k in keys if k in found.columns], F.lit(label))

    return found.groupBy(
        first_of(["dataset", "urn"], UNKNOWN_DATASET).alias("dataset"),
        first_of(["column"], UNKNOWN_COLUMN).alias("column"),
        first_of(["entry_type", "type", "issue"], UNKNOWN_TYPE).alias("type"),
    ).agg(F.count(F.lit(1)).alias("occurrences"))
