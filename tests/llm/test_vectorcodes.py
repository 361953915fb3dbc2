import hashlib
import math
import random

import numpy as np

from plumbrow.llm import vectorcodes
from plumbrow.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, entry int, v string"


def brute(rows, entries=256, rounds=4):
    """``rows``: (vec_id, vector, label), ids not null; (vec_id, code, error, label_error) of each that has a code, and the sum of all entries."""
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(np.float32(x).item() * 1024) for x in v], lab) for i, v, lab in rows if good(v) and v and len(v) % 4 == 0]
    kept.sort(key=lambda r: (r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    parts = [[tuple(v[p * w : p * w + w]) for _, v, _ in kept] for p in range(4)]
    books = [x[:entries] for x in parts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(part, book):
        return [min(range(len(book)), key=lambda k: (dist(x, book[k]), k)) for x in part]

    for _ in range(rounds):
        for p in range(4):
            own = nearest(parts[p], books[p])
            new = []
            for k, e in enumerate(books[p]):
                mine = [x for x, o in zip(parts[p], own) if o == k]
                new.append(tuple(sum(c) // len(mine) for c in zip(*mine)) if mine else e)
            books[p] = new
    owns = [nearest(parts[p], books[p]) for p in range(4)]
    codes = ["".join(f"{owns[p][i]:02x}" for p in range(4)) for i in range(len(kept))]
    errors = [sum(dist(parts[p][i], books[p][owns[p][i]]) for p in range(4)) for i in range(len(kept))]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[lab], sha) for (i, _, lab), c, e in zip(kept, codes, errors))


def got(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def test_query_against_sql(spark, sf_dir, duck):
    assert differences(QUERIES["op12_vector_codes"](spark, sf_dir), duck, ORACLES["op12_vector_codes"]) is None


def test_sql_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(QUERIES["op12_vector_codes"](spark, sf), connect(sf), ORACLES["op12_vector_codes"]) is None


def test_ties_repeats_and_a_common_vector(spark):
    """Few distinct values, so that distances tie and entries repeat; a third of the rows is one vector."""
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, -0.001, 0.0, 0.25, 1.0]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(150)] + [(5, [0.1] * 8, 3), (5, [0.1] * 8, 3)]
    rnd.shuffle(rows)
    df = make(spark, rows)
    assert got(vectorcodes.encode(df)) == brute(rows)
    assert got(vectorcodes.encode(df, entries=7, rounds=2)) == brute(rows, 7, 2)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, None, 1), (4, [1.0, None, 1.0, 1.0], 1), (5, [nan, 1.0, 1.0, 1.0], 1), (6, [inf, 1.0, 1.0, -inf], 1), (7, [], 1),
            (8, [1.0, 2.0, 3.0, -4.0], None), (9, [1.0] * 8, 1), (10, [1.0] * 6, 1), (11, [-1e-9, 0.0, 1e4, 2.0], None)]
    assert got(vectorcodes.encode(make(spark, rows))) == brute(rows)
    assert [r.vec_id for r in vectorcodes.encode(make(spark, rows)).orderBy("vec_id").collect()] == [8, 11]
    assert vectorcodes.encode(make(spark, rows[:5])).collect() == []
    out = vectorcodes.encode(make(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    lost = vectorcodes.encode(make(spark, [(None, [1.0] * 4, 1), (2, [0.5] * 4, 1), (None, [9e30] * 4, 1)])).collect()
    assert len(lost) == 3 and {r.vec_id: r.code for r in lost if r.vec_id} == {2: "00000000"}


def test_balls_hold_their_points_and_owners_are_nearest():
    rnd = np.random.default_rng(3)
    rows = np.concatenate([rnd.normal(0, 300, (900, 6)), rnd.normal(500, 4, (600, 6)), np.zeros((200, 6))]).astype(np.int64)
    tree = vectorcodes.tree_of(rows)
    assert sorted(tree.order.tolist()) == list(range(len(tree.points))) and (tree.points[tree.of_row] == rows).all()
    assert tree.count[0] == len(rows) and (tree.total[0] == rows.sum(0)).all()
    for b in range(len(tree.first)):
        own = tree.points[tree.order[tree.first[b] : tree.end[b]]]
        assert np.sqrt(((own - tree.centre[b]) ** 2).sum(1)).max() <= tree.radius[b] + 1e-9
        if tree.child[b, 0] >= 0:
            assert tree.count[b] == tree.count[tree.child[b]].sum()
    entries = np.concatenate([rows[:100], rows[:3], rnd.normal(400, 200, (60, 6)).astype(np.int64)])
    owned, own = vectorcodes.owners(tree, entries)
    want = ((tree.points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (own == want).all()
    # Balls far from the planes between entries are owned whole: here a few hold nearly all points.
    far = np.array([[0] * 6, [500] * 6, [500] * 6, [-9000] * 6])
    owned, own = vectorcodes.owners(tree, far)
    assert (own == ((tree.points[:, None] - far[None]) ** 2).sum(2).argmin(1)).all()
    whole = sum(int(tree.count[b].sum()) for b, _ in owned)
    assert whole > 0.8 * len(rows) and sum(len(b) for b, _ in owned) < 0.1 * len(rows)
