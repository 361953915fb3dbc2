"""Remediation: repairs of single defects, cleaned tables, fix reports and scripts, pausing of stages.

A repair is an expression on a column, never a pass of its own: a cleaned table costs one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbrow.functions import casts, names
from plumbrow.functions.casts import quote as _quoted
from plumbrow.operators.lineage import downstream
from plumbrow.operators.profile import (
    DATE_INVERSION,
    INVALID_AGE,
    NEGATIVE,
    NULL_OR_BLANK,
)
from plumbrow.sources.shared import cut

# The filler, the name parts of text columns, the states of a stage, report lines.
FILLER = "UNKNOWN"
TEXT_KEYWORDS = ("name", "title")
PAUSED, OPERATIONAL = "PAUSED", "OPERATIONAL"
AGE_LINE = "Fixed invalid age range in column '%s'"
NEGATIVE_LINE = "Fixed negative values in numeric column '%s'"
TEXT_LINE = "Replaced NULLs with 'UNKNOWN' in text column '%s'"
ZERO_LINE = "Replaced NULLs with 0 in column '%s'"
DATE_LINE = "Corrected inverted date logic between '%s' and '%s'"


def _number(name: str, dtype: T.DataType) -> str:
    c = _quoted(name)
    return f"try_cast({c} AS double)" if casts.is_text(dtype) else c


def clip_sql(name: str, dtype: T.DataType) -> str:
    """Negative numbers become 0, in the type of the column."""
    c, zero = _quoted(name), f"CAST('0' AS {dtype.simpleString()})"
    return f"CASE WHEN {_number(name, dtype)} < 0 THEN {zero} ELSE {c} END"


def range_sql(name: str, dtype: T.DataType, lo: float | str, hi: float | str) -> str:
    """Numbers outside the bounds become NULL; the bounds are numbers or expressions."""
    c, x = _quoted(name), _number(name, dtype)
    return f"CASE WHEN {x} < {lo} OR {x} > {hi} THEN NULL ELSE {c} END"


def fill_sql(name: str, dtype: T.DataType) -> str | None:
    """Texts get the filler and numbers 0; other types have no neutral value and stay as they are."""
    c = _quoted(name)
    if casts.is_text(dtype):
        return f"COALESCE({c}, '{FILLER}')"
    if casts.is_numeric(dtype):
        return f"COALESCE({c}, CAST('0' AS {dtype.simpleString()}))"
    return None


def _replace(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{exprs.get(c, _quoted(c))} AS {_quoted(c)}" for c in df.columns])


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _fields(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [casts.field_of(df.schema, c) for c in cols]


def clip_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _replace(df, {f.name: clip_sql(f.name, f.dataType) for f in _fields(df, cols)})


def null_out_of_range(df: DataFrame, ranges: Mapping[str, tuple]) -> DataFrame:
    bounded = zip(_fields(df, list(ranges)), ranges.values())
    return _replace(df, {f.name: range_sql(f.name, f.dataType, lo, hi) for f, (lo, hi) in bounded})


def fill_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    exprs = {f.name: fill_sql(f.name, f.dataType) for f in _fields(df, df.columns if cols is None else cols)}
    return _replace(df, {c: e for c, e in exprs.items() if e})


def _swap_sql(df: DataFrame, c1: str, c2: str) -> dict[str, str]:
    (c1, t1), (c2, t2) = ((f.name, f.dataType) for f in _fields(df, [c1, c2]))
    a, b = _quoted(c1), _quoted(c2)
    wrong = casts.is_later(a, t1, b, t2)

    def moved(c: str, to: T.DataType, other: T.DataType) -> str:
        return c if to == other else f"CAST({c} AS {to.simpleString()})"

    return {
        c1: f"CASE WHEN {wrong} THEN {moved(b, t1, t2)} ELSE {a} END",
        c2: f"CASE WHEN {wrong} THEN {moved(a, t2, t1)} ELSE {b} END",
    }


def swap_dates(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """Exchange the two values where the first lies after the second; NULLs stay where they are."""
    return _replace(df, _swap_sql(df, c1, c2))


def drop_invalid(df: DataFrame, amount: str) -> DataFrame:
    """Drop rows with a negative amount; rows without an amount stay."""
    c, dtype = _quoted(amount), casts.field_of(df.schema, amount).dataType
    x = c if casts.is_numeric(dtype) else casts.to_double(c, dtype)
    return df.filter(f"({x}) >= 0 OR ({x}) IS NULL")


class Finding(NamedTuple):
    column: str
    column_2: str | None
    issue: str
    low: float | None = None  # the bounds that a range finding was found with
    high: float | None = None


def findings_of(anomalies: DataFrame) -> list[Finding]:
    """The findings of one table. Their number is bounded by its columns, not by its rows."""
    rows = anomalies.select("column", "column_2", "issue", "low", "high").distinct().collect()
    return [Finding(*r) for r in rows]


def remediation_steps(df: DataFrame, findings: Sequence[Finding]) -> list[dict[str, str]]:
    """Column expressions per step: first all repairs of single columns, then one step per pair.

    The issue decides the repair: values outside the bounds of a range finding become NULL, negative
    numbers 0; of both findings on one column the range stands. A column with a number defect is not
    null-filled as well. Pairs follow column order, each seeing
    what the one before it left.
    """
    types, place = _types(df), {c: i for i, c in enumerate(df.columns)}
    single: dict[str, str] = {}
    for f in findings:
        if f.issue == NEGATIVE:
            single[f.column] = clip_sql(f.column, types[f.column])
    for f in findings:
        if f.issue == INVALID_AGE:
            single[f.column] = range_sql(f.column, types[f.column], f.low, f.high)
    for f in findings:
        if f.issue == NULL_OR_BLANK and f.column not in single:
            e = fill_sql(f.column, types[f.column])
            if e:
                single[f.column] = e
    pairs = sorted(
        ((f.column, f.column_2) for f in findings if f.issue == DATE_INVERSION),
        key=lambda p: (place[p[0]], place[p[1]]),
    )
    return [s for s in [single, *[_swap_sql(df, a, b) for a, b in pairs]] if s]


def remediate(df: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The cleaned table: every finding repaired, all columns kept, in order."""
    for step in remediation_steps(df, findings_of(anomalies)):
        df = _replace(df, step)
    return df


def _fixes(anomalies: DataFrame, kinds: Sequence[Finding]) -> DataFrame:
    """``dataset, fixes``: the findings of each dataset as a map from the place of their kind in ``kinds`` to their bounds.

    A map holds no more than the kinds do, however many rows or datasets there are. If a dataset has two findings of a kind
    with different bounds, a value must lie within both.
    """
    listed = [(i, k.column, k.column_2, k.issue) for i, k in enumerate(kinds)]
    kind = anomalies.sparkSession.createDataFrame(listed, "kind int, c1 string, c2 string, i string")
    same = (F.col("column") == F.col("c1")) & F.col("column_2").eqNullSafe(F.col("c2")) & (F.col("issue") == F.col("i"))
    one = anomalies.join(kind, same).groupBy("dataset", "kind").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    bounds = F.collect_list(F.struct("kind", F.struct("low", "high")))
    return one.groupBy("dataset").agg(F.map_from_entries(bounds).alias("fixes"))


def _free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if a column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remediate_datasets(df: DataFrame, anomalies: DataFrame, by: str) -> DataFrame:
    """The cleaned rows of many datasets in one table, each repaired by its own findings, as ``remediate`` repairs one.

    ``by`` is the column that ``profile(by=)`` took the datasets from; the findings may be of millions of them. They are data here:
    one map a dataset, which its rows are joined with, so the table is read once and nothing of a dataset is collected.
    What the driver gets is the kinds of findings, at most a few for each column and pair of columns. Rows without a dataset
    are repaired by the findings of a null one; those of a dataset without findings stay as they are. Rows, columns and types are kept.
    """
    types, place = _types(df), {c: i for i, c in enumerate(df.columns)}
    found = cut(anomalies.select("dataset", "column", "column_2", "issue", "low", "high"), "findings")
    kinds = [Finding(*k) for k in sorted(found.select("column", "column_2", "issue").distinct().collect(), key=str)]
    if not kinds:
        return df
    dataset, fixes = _free_name(df, "fixed_dataset"), _free_name(df, "fixes")
    # Written, so that its size is known and a dataset with many rows can be split: its map is one row.
    maps = cut(_fixes(found, kinds).toDF(dataset, fixes), "fixes")
    out = df.join(maps, F.col(_quoted(by)).eqNullSafe(F.col(dataset)), "left").select(*map(_quoted, df.columns), fixes)

    repairs: dict[str, dict[str, str]] = {}  # by column and issue: the branch of its repair
    for i, (column, _, issue, *_) in enumerate(kinds):
        dtype, bound = types[column], f"{fixes}[{i}]"
        if issue == NEGATIVE:
            fixed = clip_sql(column, dtype)
        elif issue == INVALID_AGE:
            fixed = range_sql(column, dtype, f"{bound}.low", f"{bound}.high")
        elif issue == NULL_OR_BLANK:
            fixed = fill_sql(column, dtype)
        else:
            continue
        if fixed:
            repairs.setdefault(column, {})[issue] = f"WHEN {bound} IS NOT NULL THEN {fixed}"
    # The first that a dataset has stands: the range, then the sign, then the missing values.
    order = (INVALID_AGE, NEGATIVE, NULL_OR_BLANK)
    branches = {c: " ".join(r[i] for i in order if i in r) for c, r in repairs.items()}
    steps = [{c: f"CASE {b} ELSE {_quoted(c)} END" for c, b in branches.items()}]
    pairs = [(k.column, k.column_2, i) for i, k in enumerate(kinds) if k.issue == DATE_INVERSION]
    for a, b, i in sorted(pairs, key=lambda p: (place[p[0]], place[p[1]])):
        swapped = _swap_sql(df, a, b)
        steps.append({c: f"CASE WHEN {fixes}[{i}] IS NOT NULL THEN {e} ELSE {_quoted(c)} END" for c, e in swapped.items()})
    for step in steps:
        out = _replace(out, step)
    return out.drop(fixes)


def fix_script(df: DataFrame, anomalies: DataFrame, table: str) -> str:
    """The SQL that builds ``cleaned_<table>``, from the same expressions as ``remediate``."""
    findings = findings_of(anomalies)
    types = _types(df)
    ranged = {f.column for f in findings if f.issue == INVALID_AGE}
    numbers = ranged | {f.column for f in findings if f.issue == NEGATIVE}
    told = [
        f
        for f in findings
        if not (f.issue == NEGATIVE and f.column in ranged) and not (f.issue == NULL_OR_BLANK and f.column in numbers)
    ]
    lines = sorted({x for x in (_line(f, types) for f in told) if x})
    steps = remediation_steps(df, findings) or [{}]
    source = _quoted(table)
    for step in steps:
        cols = ",\n  ".join(f"{step.get(c, _quoted(c))} AS {_quoted(c)}" for c in df.columns)
        source = f"(SELECT\n  {cols}\nFROM {source})"
    head = "".join(f"--   * {x}\n" for x in lines) or "--   (none)\n"
    return (
        f"-- Remediation script\n-- Target table: {table}\n-- Generated fixes:\n{head}"
        f"CREATE OR REPLACE TABLE {_quoted('cleaned_' + table)} AS\n{source[1:-1]};\n"
    )


def _line(f: Finding, types: Mapping[str, T.DataType]) -> str | None:
    if f.issue == DATE_INVERSION:
        return DATE_LINE % (f.column, f.column_2)
    if f.issue in (NEGATIVE, INVALID_AGE):
        return (AGE_LINE if f.issue == INVALID_AGE else NEGATIVE_LINE) % f.column
    if casts.is_text(types[f.column]):
        return TEXT_LINE % f.column
    return ZERO_LINE % f.column if casts.is_numeric(types[f.column]) else None


def fix_report(anomalies: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """``dataset, line``: one line per repair, for any number of datasets.

    A column with a number defect has no line for its missing values, and one with a range finding none
    for its negative numbers, as in the cleaned table. With
    the ``schema`` of the datasets, the lines follow the types, as the cleaned table does, and
    columns without a neutral value have none; without it, names tell text from numbers.
    """
    null = F.col("issue") == NULL_OR_BLANK
    number = F.col("issue").isin(NEGATIVE, INVALID_AGE)
    # A window over the findings of one column, of which there are a handful.
    of_column = Window.partitionBy("dataset", "column")
    ranged = F.col("issue") == INVALID_AGE
    kept = (
        anomalies.withColumns({"fixed": F.max(number).over(of_column), "ranged": F.max(ranged).over(of_column)})
        .filter(~(null & F.col("fixed")))
        .filter(~((F.col("issue") == NEGATIVE) & F.col("ranged")))
    )
    if schema is None:
        is_text = names.column_has(F.col("column"), TEXT_KEYWORDS)
    else:
        texts = [f.name for f in schema.fields if casts.is_text(f.dataType)]
        numbers = [f.name for f in schema.fields if casts.is_numeric(f.dataType)]
        is_text = F.col("column").isin(texts)
        kept = kept.filter(~null | is_text | F.col("column").isin(numbers))

    def line(form: str) -> Column:
        return F.format_string(form, "column")

    text = (
        F.when(F.col("issue") == DATE_INVERSION, F.format_string(DATE_LINE, "column", "column_2"))
        .when(null, F.when(is_text, line(TEXT_LINE)).otherwise(line(ZERO_LINE)))
        .otherwise(F.when(ranged, line(AGE_LINE)).otherwise(line(NEGATIVE_LINE)))
    )
    return kept.select("dataset", text.alias("line")).distinct()


def column_edges(edges: DataFrame, columns: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """``src, dst`` between columns, each named by ``column_key``: how columns pass along ``edges(src, dst)`` of tables.

    A column of a table comes from the column of the same name in the tables above it, or where ``renames(dataset, column,
    source_column)`` names another one, from that one only. A table above that does not carry it passes nothing on.
    ``columns(dataset, column)`` has the columns of all tables.
    """
    own = columns.select("dataset", "column").distinct()
    below = own.withColumn("source_column", F.col("column"))
    if renames is not None:
        named = renames.select("dataset", "column", "source_column").distinct()
        below = own.join(named, ["dataset", "column"], "left").withColumn("source_column", F.coalesce("source_column", "column"))
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    below = links.join(below, links["dst"] == below["dataset"]).select("src", "source_column", "dst", "column")
    above = own.select(F.col("dataset").alias("src"), F.col("column").alias("source_column"))
    carried = below.join(above, ["src", "source_column"], "left_semi")
    return carried.select(column_key("src", "source_column").alias("src"), column_key("dst", "column").alias("dst"))


def column_key(dataset: str, column: str) -> Column:
    return F.to_json(F.array(dataset, column))


def circuit_breaker(
    anomalies: DataFrame,
    edges: DataFrame,
    columns: DataFrame,
    watch: DataFrame | None = None,
    renames: DataFrame | None = None,
    threshold_pct: float = 0.0,
) -> DataFrame:
    """``dataset, status, defects``: which downstream tables to pause and how many defects reach them.

    A defect of an upstream table reaches a table below it if ``watch(dataset, column, issue)``
    says so, or, without ``watch``, if its column does: it is followed from table to table, by name or through
    ``renames(dataset, column, source_column)``, and ends at a table that does not carry it (``column_edges``);
    ``columns(dataset, column)`` has the columns of all tables that do, those with defects too.
    A defect of ``threshold_pct`` percent of the rows or fewer pauses nothing; with 0 a single bad row does.
    A pair of dates in the wrong order is one defect of a table, whichever of the two it carries.
    """
    # Counted once: the findings are few, and the tables behind them are not. The share is exact, as
    # ``pct`` rounds a rare defect of a large table to 0.
    share = F.col("bad_rows") * 100.0 / F.col("total_rows")
    anomalies = cut(anomalies.filter(share > threshold_pct), "anomalies")
    bad = anomalies.select(
        F.col("dataset").alias("start"),
        F.concat_ws("|", "column", "column_2", "issue").alias("defect"),
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.col("column"), F.col("issue")),
                    F.struct(F.col("column_2").alias("column"), F.col("issue")),
                ),
                lambda x: x["column"].isNotNull(),
            )
        ),
    )
    if watch is not None:
        reach = downstream(edges, bad.select(F.col("start").alias("id")), hops=None)
        exposed = bad.join(reach.select("start", F.col("node").alias("dataset")), "start")
        hit = exposed.join(watch.select("dataset", "column", "issue"), ["dataset", "column", "issue"], "left_semi")
    else:
        bad = bad.withColumn("at", column_key("start", "column"))
        sources = bad.select(F.col("start").alias("dataset"), "column")  # a table carries the columns it has defects in
        carried = columns.select("dataset", "column").union(sources)
        reach = downstream(column_edges(edges, carried, renames), bad.select(F.col("at").alias("id")), hops=None)
        reached = reach.select(F.col("start").alias("at"), F.from_json("node", "array<string>")[0].alias("dataset"))
        hit = bad.join(reached, "at")
    hits = (
        hit.select("dataset", "start", "defect").distinct()
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("defects"))
    )
    tables = edges.select(F.col("dst").alias("dataset")).distinct()
    n = F.coalesce("defects", F.lit(0))
    return tables.join(hits, "dataset", "left").select(
        "dataset", F.when(n > 0, F.lit(PAUSED)).otherwise(F.lit(OPERATIONAL)).alias("status"), n.alias("defects")
    )
