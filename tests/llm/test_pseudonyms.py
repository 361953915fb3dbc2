import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from plumbrow.llm import pseudonyms
from plumbrow.llm.queries import QUERIES

KEY = "k"


def brute_feistel(a, b, ma, mb, use, key=KEY):
    for i in range(10):
        other = b if i % 2 == 0 else a
        add = int(hashlib.sha256(f"{key}|{use}|{i}|{other}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            a = (a + add) % ma
        else:
            b = (b + add) % mb
    return a, b


def brute_digits(d, use):
    u = len(d) // 2
    v = len(d) - u
    a, b = brute_feistel(int(d[:u]), int(d[u:]), 10**u, 10**v, use)
    return str(a).zfill(u) + str(b).zfill(v)


def luhn(d):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10


def with_check(body):
    return body + str((10 - luhn(body + "0")) % 10)


def run(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, text string")
    return [(r.text, r.n_replaced) for r in pseudonyms.pseudonymize(df, KEY).orderBy("doc_id").collect()]


def test_formats_against_brute_force(spark):
    card = with_check("4111222233334444"[:15])
    spaced = f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"
    new = with_check("4" + brute_digits(card[1:15], "card"))
    phone = brute_digits("7435553824", "phone")
    day = (dt.date(1987, 6, 5) - dt.date(1900, 1, 1)).days
    a, b = brute_feistel(day // 270, day % 270, 270, 270, "date")
    moved = dt.date(1900, 1, 1) + dt.timedelta(a * 270 + b)
    x, y = brute_feistel(10 * 256 + 1, 2 * 256 + 3, 65536, 65536, "address")
    got = run(spark, [
        f"pay {card}, {card}.", spaced, "call +1 (743) 555-3824!", "(743) 555-3824", "743-555-3824", "born 1987-06-05 or 06/05/1987 or 05.06.1987",
        "from 10.1.2.3.", "mail Some.One+x@mail.example.com now",
    ])
    assert got[0] == (f"pay {new}, {new}.", 2) and luhn(new) == 0
    assert got[1][0] == f"{new[:4]} {new[4:8]} {new[8:12]} {new[12:]}"
    assert got[2][0] == f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}!"
    assert got[3][0] == f"({phone[:3]}) {phone[3:6]}-{phone[6:]}" and got[4][0] == f"{phone[:3]}-{phone[3:6]}-{phone[6:]}"
    assert got[5] == (f"born {moved:%Y-%m-%d} or {moved:%m/%d/%Y} or {moved:%d.%m.%Y}", 3)
    assert got[6][0] == f"from {x // 256}.{x % 256}.{y // 256}.{y % 256}."
    assert got[7][0].startswith("mail u") and got[7][0].endswith("@mail.example.com now") and "One" not in got[7][0]


def test_what_is_not_valid_stays(spark):
    bad = ["4111222233334445" if luhn("4111222233334445") else "4111222233334446", "1987-13-05", "30.02.2001", "256.1.2.3", "1.2.3.4.5", "666-12-3456",
           "000-12-3456", "123-00-4567", "12345678901234567890", "a@b", "1850-01-01", "version 3.14", "", "no data"]
    assert run(spark, bad) == [(v, 0) for v in bad]
    assert run(spark, [None, "5" * 200_000]) == [(None, 0), ("5" * 200_000, 0)]


@pytest.mark.parametrize("kind", ["date", "ssn", "digits"])
def test_permutations(spark, kind):
    """Every value of a format goes to another value of it, each to its own."""
    n = {"date": 72_900, "ssn": 3000, "digits": 1000}[kind]
    if kind == "date":
        text = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    elif kind == "ssn":
        text = F.format_string("%03d-%02d-%04d", F.col("id") % 600 + 1, F.col("id") % 99 + 1, F.col("id") + 1)
    else:
        text = F.lpad(F.col("id").cast("string"), 3, "0")
    df = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    if kind == "digits":
        got = [r[0] for r in df.select(pseudonyms.digits_permuted(F.col("text"), KEY, "x")).collect()]
        assert sorted(got) == [f"{i:03d}" for i in range(1000)] and got[7] == brute_digits("007", "x")
        return
    out = pseudonyms.pseudonymize(df, KEY)
    seen = out.select("text").distinct()
    assert seen.count() == n and out.filter("n_replaced = 1").count() > 0.99 * n
    assert pseudonyms.pseudonymize(seen.selectExpr("0 AS doc_id", "text"), "other").filter("n_replaced = 1").count() > 0.99 * n


def test_query_links_values_and_leaves_the_rest(spark, sf_dir, texts):
    import re

    found = re.compile(r"[\w.+-]+@[\w.-]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+")
    rows = {r.doc_id: r for r in QUERIES["op6_pii_pseudonyms"](spark, sf_dir).collect()}
    pairs = {}
    for i, t in texts.items():
        if rows[i].n_replaced == 0:
            assert rows[i].text == t
        old, new = found.findall(t), found.findall(rows[i].text)
        assert len(old) == len(new)
        for a, b in zip(old, new):
            assert a != b and pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs) > 3 and len(rows) == len(texts)


def test_nothing_but_expressions(spark, sf_dir):
    plan = QUERIES["op6_pii_pseudonyms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
