import pytest
from pyspark.sql import functions as F

from plumbrow.operators import plant, profile as p
from plumbrow.plans import inputs
from tests.test_profile import found


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 501])
@pytest.mark.parametrize("digits", [1, 4])
def test_exactly_n_rows_are_picked(spark, n, digits, monkeypatch):
    monkeypatch.setattr(plant, "_DIGITS", digits)
    df = spark.range(500)
    hit = df.filter(plant.pick(df, "id", "s", n))
    order = df.select("id", plant.pick_order("id", "s").alias("h")).orderBy("h").limit(n)
    assert sorted(r.id for r in hit.collect()) == sorted(r.id for r in order.collect())
    assert hit.count() == min(n, 500)


def test_only_rows_that_meet_the_condition(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0))
    hit = df.filter(plant.pick(df, "id", "s", 100, F.col("x")))
    assert hit.count() == 100 and hit.filter("x").count() == 100
    assert df.filter(plant.pick(df, "id", "s", 5000, F.col("x"))).count() == df.filter("x").count()


def test_a_key_that_is_not_unique_is_refused(spark):
    df = spark.range(10).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError):
        plant.pick(df, "id", "s", 3)


def test_planted_defects_are_found_again(spark, sf_dir):
    clean = inputs.patients(spark, sf_dir, dirty=False)
    total = clean.count()
    assert not found(p.profile(clean))
    got = {k[1:]: v[0] for k, v in found(p.profile(plant.plant(clean, "visit_id", plant.patient_rules(total)))).items()}
    ages = int(total * 0.015)
    assert got[("billing_amount", None, p.NEGATIVE)] == int(total * 0.02)
    assert got[("name", None, p.NULL_OR_BLANK)] == int(total * 0.01)
    assert got[("age", None, p.INVALID_AGE)] == ages
    assert got[("date_of_admission", "discharge_date", p.DATE_INVERSION)] == int(total * 0.005)


def test_rules_see_what_earlier_ones_did(spark):
    df = spark.range(100).withColumn("v", F.lit(1))
    rules = [
        plant.Rule("a", {"v": F.col("v") * -1}, rate=0.4),
        plant.Rule("b", {"v": F.col("v") + 200}, rows=10, where=F.col("v") > 0),
    ]
    values = {r.v: r["count"] for r in plant.plant(df, "id", rules).groupBy("v").count().collect()}
    assert values == {-1: 40, 201: 10, 1: 50}


def test_planting_is_a_map_over_the_table(spark):
    df = spark.range(1000).withColumn("v", F.lit(1))
    out = plant.plant(df, "id", [plant.Rule("a", {"v": F.lit(2)}, rate=0.3)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_cut_and_empty_day(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-31')) AS d, 5L AS n, 1.5D AS x")
    cut = plant.cut_after(days, "d")
    assert str(cut.agg(F.max("d")).first()[0]) == "2024-01-28"
    zero = plant.zero_day(cut, "d", ["n", "x"], plant.days_before_last(days, "d", 10))
    assert [(str(r.d), r.n, r.x) for r in zero.filter("n = 0").collect()] == [("2024-01-21", 0, 0.0)]
    assert zero.schema == cut.schema or zero.schema.simpleString() == cut.schema.simpleString()


def test_rules_share_scans_and_pick_the_rows_they_pick_alone(spark, monkeypatch):
    """Five rules in two waves; what each picks does not depend on which rules it is searched with."""
    df = spark.range(3000).selectExpr("id", "CAST(id % 90 AS string) AS age", "'x' AS name", "5 AS amount", "1 AS order_of_rule_1")
    age = F.col("age").try_cast("int")

    def rules(told):
        return [
            plant.Rule("m", {"amount": -F.col("amount")}, rate=0.02, reads=told and ["amount"]),
            plant.Rule("n", {"name": F.lit(None).cast("string")}, rows=30, where=F.col("name").isNotNull(), reads=told and ["name"]),
            plant.Rule("low", {"age": (-age).cast("string")}, rows=40, reads=told and ["age"]),
            plant.Rule("high", {"age": (age + 200).cast("string")}, rows=50, where=age > 0, reads=told and ["age"]),
            plant.Rule("none", {"amount": F.lit(9)}, rows=0, reads=told and []),
            plant.Rule("all", {"order_of_rule_1": F.lit(2)}, rows=10_000, where=F.col("id") < 10, reads=told and ["id"]),
        ]

    searches, search = [], plant._thresholds
    monkeypatch.setattr(plant, "_thresholds", lambda orders, *rest: searches.append(sorted(orders)) or search(orders, *rest))
    together, apart = plant.plant(df, "id", rules(True)), None
    assert searches == [[0, 1, 2, 5], [3]]
    searches.clear()
    apart = plant.plant(df, "id", rules(None))
    assert searches == [[0], [1], [2], [3], [5]]
    got = sorted(map(tuple, together.collect()))
    assert got == sorted(map(tuple, apart.collect())) and together.columns == df.columns
    assert [sum(x) for x in zip(*((r[3] == -5, r[2] is None, r[1].startswith("-"), int(r[1]) > 200, r[4] == 2) for r in got))][:2] == [60, 30]
    assert sum(r[4] == 2 for r in got) == 10 and sum(int(r[1]) > 200 for r in got) == 50
