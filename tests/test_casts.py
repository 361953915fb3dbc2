import pytest
from pyspark.sql import functions as F, types as T

from plumbrow.functions import casts, names

TEXT = T.StringType()


def values(spark, expr, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(F.expr(expr)).collect()]


REALS = {
    "12.5": (12.5, 12.5),
    " -3 ": (-3.0, -3.0),
    "-12abc": (None, -12.0),
    "": (None, 0.0),
    "abc": (None, 0.0),
    "2024-01-31": (None, 2024.0),
    "1e3": (1000.0, 1000.0),
    "-Infinity": (None, 0.0),
    "NaN": (None, 0.0),
    None: (None, None),
}


@pytest.mark.parametrize("mode", [casts.STRICT, casts.COMPAT])
def test_text_to_double(spark, mode):
    got = values(spark, casts.to_double("c", TEXT, mode), list(REALS))
    assert got == [v[mode == casts.COMPAT] for v in REALS.values()]


INTS = {"45.9": (45, 45), "1e3": (1000, 1), "abc": (None, 0), "-7": (-7, -7), "99999999999": (None, None), None: (None, None)}


@pytest.mark.parametrize("mode", [casts.STRICT, casts.COMPAT])
def test_text_to_int(spark, mode):
    got = values(spark, casts.to_int("c", TEXT, mode), list(INTS))
    assert got == [v[mode == casts.COMPAT] for v in INTS.values()]


def test_negative_part(spark):
    texts = ["-1", "  -2.5", "\t-4", "-abc", "-", "1", "Male", " Male", "-.5", "- 3", "-0", "-1e999", None, "-2 "]
    strict = values(spark, casts.negative_part("c", TEXT), texts)
    assert strict == [-1.0, -2.5, -4.0, None, None, None, None, None, -0.5, None, None, None, None, -2.0]
    compat = values(spark, casts.negative_part("c", TEXT, casts.COMPAT), ["-12abc", "-x", "x-1", " -3kg"])
    assert compat == [-12.0, None, None, -3.0]


def test_negative_part_agrees_with_the_plain_test(spark):
    import random

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("-+. 01e\tx,") for _ in range(rnd.randint(0, 5))) for _ in range(3000)]
    plain = casts.to_double("c", TEXT)
    got = values(spark, casts.negative_part("c", TEXT), texts)
    assert got == values(spark, f"CASE WHEN ({plain}) < 0 THEN {plain} END", texts)


def test_epoch(spark):
    row = spark.range(1).select(
        F.expr(casts.to_epoch_ms("1700000000", T.LongType())).alias("seconds"),
        F.expr(casts.to_epoch_ms("1700000000123", T.LongType())).alias("millis"),
        F.expr(casts.to_epoch_ms("'2024-01-31T00:00:00Z'", TEXT)).alias("iso"),
        F.expr(casts.to_epoch_ms("'2024-01-31'", TEXT)).alias("day"),
        F.expr(casts.to_epoch_ms("'junk'", TEXT)).alias("junk"),
    ).first()
    assert tuple(row) == (1700000000000, 1700000000123, 1706659200000, 1706659200000, None)
    assert casts.to_epoch_ms("c", T.ArrayType(T.IntegerType())) is None


def test_unknown_mode():
    with pytest.raises(ValueError):
        casts.to_double("c", TEXT, "loose")


def test_names(spark):
    assert names.tokens("tripDuration_min") == ["trip", "duration", "min"]
    assert names.name_has("page_id", ["age"]) and not names.name_has("page_id", ["age"], names.TOKEN)
    assert names.name_has("patientAge", ["age"], names.TOKEN)
    df = spark.createDataFrame([("p_name",), ("hostname",), ("userName",), ("page",)], "c string")
    assert [r[0] for r in df.select(names.column_has(F.col("c"), ["name"])).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(names.column_has(F.col("c"), ["name"], names.TOKEN)).collect()] == [
        True, False, True, False,
    ]
