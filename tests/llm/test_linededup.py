import hashlib

import numpy as np
import pytest

from plumbrow.llm import linededup
from plumbrow.llm.queries import ORACLES, QUERIES
from tests.compare import differences


def brute(rows, shortest=10):
    """Rows of (id, text); those without an id are one document that comes last."""
    last = 1 << 63
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        me = last if i is None else i
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= shortest and len(holders[key(x)]) > 1 and min(holders[key(x)]) != me for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept, r.kept_sha256) for r in df.collect()), key=str)


def test_query_against_sql(spark, sf_dir, duck):
    assert differences(QUERIES["op5_line_dedup"](spark, sf_dir), duck, ORACLES["op5_line_dedup"]) is None


ROWS = [
    (5, "a line of words\nshort\nA LINE of words \nunique line one"), (3, "\t a line of words\x0b\nshort\nÄäääääääää!"),
    (9, "a line of words"), (1, None), (2, ""), (4, "\n\n"), (6, "x" * 100_000 + "\nÄäääääääää!"), (8, "x" * 100_000),
    (7, "same row twice\nsame row twice"), (7, "same row twice\nsame row twice"), (None, "a line of words\nno id here!"),
    (None, "no id here!"), (10, "äääääää"), (11, "äääääää"), (12, "ten chars!"), (13, "ten chars!\r\nnine char"),
]


def test_odd_lines(make_docs):
    assert rows_of(linededup.dedup_lines(make_docs(ROWS))) == brute(ROWS)
    assert linededup.dedup_lines(make_docs([])).count() == 0


@pytest.mark.parametrize("most_bits", [1, 20])
def test_a_full_filter_changes_nothing(documents, texts, most_bits):
    got = linededup.dedup_lines(documents, most_bits=most_bits, carry=("source",))
    assert rows_of(got) == brute(list(texts.items()))
    assert got.select("carried.source").distinct().count() > 1


def test_filters_miss_nothing(spark):
    rows = [(h * 0x9E3779B97F4A7C15 % (1 << 63), False) for h in range(3000)] + [(7, True)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "hash bigint, twice boolean").repartition(5)
    for bits in (18, 19):
        seen, place = linededup.twice_seen(df, bits), linededup._Place(bits)

        def hits(h):
            return np.all([(seen[place.segment(h), p >> 3] >> (7 - (p & 7))) & 1 for p in place.probes(h)], axis=0)

        assert hits(np.array([r[0] for r in rows[-500:]] + [7], np.uint64)).all()
        assert hits(np.array([r[0] for r in rows[500:3000]], np.uint64)).mean() < 0.02
