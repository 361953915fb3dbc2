"""Planting of known defects, so that the detectors can be tested on tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# Shares of rows per defect, days cut off, the empty day before the cut.
NEGATIVE_RATE = 0.02
NULL_RATE = 0.01
AGE_RATE = 0.015
SWAP_RATE = 0.005
STALE_DAYS = 3
EMPTY_DAY_BEFORE_CUT = 7

_DIGITS = 4  # hexadecimal digits looked at per round: 65536 counters


@dataclass(frozen=True)
class Rule:
    """Rewrite ``columns`` on exactly ``rows`` rows (or ``int(rate * all rows)``) that meet ``where``.

    ``reads`` names the columns that ``where`` and the new values read; None stands for any.
    """

    seed: str
    columns: Mapping[str, Column]
    rate: float = 0.0
    rows: int | None = None
    where: Column | None = None
    reads: Sequence[str] | None = None


def pick_order(key: str, seed: str) -> Column:
    """A fixed random order of the rows; the same in any engine that has md5."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)))


def _thresholds(orders: Mapping[int, Column], df: DataFrame, wanted: Mapping[int, int]) -> dict[int, str | None]:
    """For each number in ``wanted`` a text such that exactly so many values of its order, a column of ``df``, have it, or less, as head.

    Counts the values of all orders by their next four digits in one aggregate, steps into the one group of each in which
    its n-th value lies, and counts again. Each round is one scan and a small aggregate for all orders together, so no
    task ever sorts or holds the picked rows, however many they are. Values that are null do not count; None if there are no more
    than the number wanted.
    """
    heads, left, found = dict.fromkeys(wanted, ""), dict(wanted), {}
    while heads:
        if any(len(h) >= 32 for h in heads.values()):
            raise ValueError("the key of a planted table must be unique")
        nexts = [
            F.when(F.startswith(orders[k], F.lit(h)), F.struct(F.lit(k).alias("rule"), F.substring(orders[k], len(h) + 1, _DIGITS).alias("g")))
            for k, h in heads.items()
        ]
        groups = df.select(F.inline(F.array_compact(F.array(*nexts)))).groupBy("rule", "g").count()
        # At most 65536 rows for a rule, whatever the table: one task can add them up.
        upto = groups.withColumn("upto", F.sum("count").over(Window.partitionBy("rule").orderBy("g")))
        goal = F.create_map(*[F.lit(x) for k in heads for x in (k, left[k])])[F.col("rule")]
        rows = {r["rule"]: r for r in upto.filter((F.col("upto") >= goal) & (F.col("upto") - F.col("count") < goal)).collect()}
        for k in list(heads):
            row = rows.get(k)
            if row is None:
                found[k] = None
                del heads[k]
                continue
            heads[k] += row["g"]
            left[k] -= row["upto"] - row["count"]
            if left[k] == row["count"]:
                found[k] = heads.pop(k)
    return found


def _hit(order: Column, eligible: Column, n: int, limit: str | None) -> Column:
    if n <= 0:
        return F.lit(False)
    return eligible if limit is None else eligible & (F.substring(order, 1, len(limit)) <= limit)


def _eligible(where: Column | None) -> Column:
    return F.lit(True) if where is None else F.coalesce(where, F.lit(False))


def pick(df: DataFrame, key: str, seed: str, n: int, where: Column | None = None) -> Column:
    """A condition that holds for exactly ``n`` rows of ``df``, or for all that meet ``where``."""
    order, eligible = pick_order(key, seed), _eligible(where)
    limit = _thresholds({0: F.when(eligible, order)}, df, {0: n})[0] if n > 0 else None
    return _hit(order, eligible, n, limit)


def _waves(key: str, rules: Sequence[Rule]) -> list[int]:
    """For each rule the wave in which its rows can be found: the one after those of all earlier rules that write what it reads."""
    out: list[int] = []
    for k, rule in enumerate(rules):
        reads = None if rule.reads is None else {c.lower() for c in (key, *rule.reads)}
        needs = [out[j] for j in range(k) if reads is None or reads & {c.lower() for c in rules[j].columns}]
        out.append(max(needs, default=-1) + 1)
    return out


def plant(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """Apply the rules one after the other; a later one may hit rows that an earlier one changed.

    ``key`` must be unique. The result is a map over ``df``: the picked rows are known by one
    comparison with their hash, so nothing is joined or sorted. The hashes to compare with are found for all rules of
    a wave in the same scans: a rule waits only for earlier ones that write a column it reads (``Rule.reads``).
    """
    total = df.count() if any(r.rows is None for r in rules) else 0
    wanted = [int(total * r.rate) if r.rows is None else r.rows for r in rules]
    waves, limits = _waves(key, rules), {}
    name = "order_of_rule_"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"

    def applied(out: DataFrame, k: int) -> DataFrame:
        hit = _hit(pick_order(key, rules[k].seed), _eligible(rules[k].where), wanted[k], limits.get(k))
        # All new values come from the row as it was, so two columns can be exchanged.
        new = {c: F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in rules[k].columns.items()}
        return out.select(*[new.get(c, F.col(c)) for c in out.columns])

    for wave in range(max(waves, default=-1) + 1):
        seen, searched = df, {}
        for k, rule in enumerate(rules):
            if waves[k] < wave:
                seen = applied(seen, k)
            elif waves[k] == wave and wanted[k] > 0:
                searched[k] = wanted[k]
                seen = seen.withColumn(f"{name}{k}", F.when(_eligible(rule.where), pick_order(key, rule.seed)))
        if searched:
            limits |= _thresholds({k: F.col(f"{name}{k}") for k in searched}, seen, searched)
    for k in range(len(rules)):
        df = applied(df, k)
    return df


def patient_rules(total: int) -> list[Rule]:
    """The four defects of the patient table of ``total`` rows, whose columns are all text.

    Texts that are no numbers stay as they are.
    """
    amount, age = F.col("billing_amount"), F.col("age").try_cast("int")
    minus = F.concat(F.lit("-"), F.regexp_replace(F.trim(amount), "^[+-]", ""))
    ages = int(total * AGE_RATE)
    return [
        Rule(
            "billing",
            {"billing_amount": F.when(amount.try_cast("double").isNotNull(), minus).otherwise(amount)},
            rows=int(total * NEGATIVE_RATE),
            reads=["billing_amount"],
        ),
        Rule(
            "name",
            {"name": F.lit(None).cast("string")},
            rows=int(total * NULL_RATE),
            where=F.col("name").isNotNull(),
            reads=["name"],
        ),
        Rule(
            "age-low",
            {"age": F.coalesce((-F.abs(age)).cast("string"), F.col("age"))},
            rows=ages // 2,
            reads=["age"],
        ),
        Rule("age-high", {"age": (F.abs(age) + 200).cast("string")}, rows=ages - ages // 2, where=age > 0, reads=["age"]),
        Rule(
            "dates",
            {"date_of_admission": F.col("discharge_date"), "discharge_date": F.col("date_of_admission")},
            rows=int(total * SWAP_RATE),
            where=F.col("date_of_admission") < F.col("discharge_date"),
            reads=["date_of_admission", "discharge_date"],
        ),
    ]


def days_before_last(df: DataFrame, day_col: str, days: int = STALE_DAYS) -> Column:
    """The day that lies ``days`` before the last one, as a value to compare with."""
    return F.date_sub(df.agg(F.max(day_col)).scalar(), days)


def cut_after(
    df: DataFrame, day_col: str, days: int = STALE_DAYS, reference: DataFrame | None = None
) -> DataFrame:
    """Drop the rows later than ``days`` before the last day (of ``reference``, by default ``df``)."""
    cutoff = days_before_last(df if reference is None else reference, day_col, days)
    return df.filter(F.col(day_col) <= cutoff)


def zero_day(df: DataFrame, day_col: str, measures: Sequence[str], day: Column) -> DataFrame:
    """Set all measures of one day to 0, as a run that loaded nothing would leave them."""
    types = {f.name: f.dataType for f in df.schema.fields}
    hit = F.col(day_col) == day
    zero = {c: F.when(hit, F.lit(0).cast(types[c])).otherwise(F.col(c)).alias(c) for c in measures}
    return df.select(*[zero.get(c, F.col(c)) for c in df.columns])
