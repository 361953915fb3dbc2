import numpy as np

from plumbrow.llm import nbsvm
from plumbrow.llm.features import DIMENSIONS, Indicators
from plumbrow.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null").collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    good = [got[r.doc_id].score for r in labels if r.quality == 1 and r.doc_id in got]
    bad = [got[r.doc_id].score for r in labels if r.quality == 0 and r.doc_id in got]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95


def test_features_do_not_depend_on_neighbours(texts):
    utf8 = [t.encode() for t in list(texts.values())[:50]] + [b"", b"a", b"a a", b"A,a !!! !!!!", "É é".encode()]
    together = Indicators().lists(utf8)
    assert all((x == Indicators().lists([t])[0]).all() for x, t in zip(together, utf8))
    assert together[50].tolist() == [0] and all((np.diff(x) > 0).all() for x in together)
    wanted = np.zeros(DIMENSIONS, bool)
    wanted[::3] = True
    some = Indicators(wanted).lists(utf8)
    assert all(set(s) == {f for f in x if wanted[f]} | {0} for s, x in zip(some, together))
    assert (Indicators().lists([b"word, word."])[0] != Indicators().lists([b"word other."])[0].sum()).any()


def test_dual_descent_reaches_the_best_loss():
    """Against subgradient steps on the same loss."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(40, 5))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    y = np.sign(x[:, 0] + 0.3 * rnd.normal(size=40))
    rows = [(np.arange(5), v) for v in x]
    w = nbsvm.dual_descent(rows, y, np.full(40, 2.0), epochs=500, seed=0)[:5]
    loss = lambda w: w @ w / 2 + 2 * np.maximum(0, 1 - y * (x @ w)).sum()
    best = np.zeros(5)
    least = loss(best)
    v = best.copy()
    for i in range(1, 40_000):
        v -= (v - 2 * ((y * (x @ v) < 1) * y) @ x) / i
        least = min(least, loss(v))
    assert loss(w) <= least * 1.002


def test_odd_tables(spark, make_docs):
    texts = ["good words are here"] * 12 + ["BAD!! NOISE!! ###"] * 12 + [None, "", (40, "good words"), (40, "good words"), (None, "BAD!! NOISE!!"), (41, "z " * 50_000)]
    docs = make_docs(texts)
    known = spark.createDataFrame([(i, int(i < 12)) for i in range(24)] + [(24, None), (99, 1), (41, 7)], "doc_id bigint, label int")
    got = {}
    for r in nbsvm.score(docs, nbsvm.fit(docs, known)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    assert got[0][0].score > 0.7 > 0.3 > got[12][0].score and got[None][0].predicted == 0
    assert got[24][0].score == got[25][0].score and got[40][0] == got[40][1]
    for labels in (known.filter("label = 1"), known.filter("false")):
        scores = {r.score for r in nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert nbsvm.score(make_docs([]), nbsvm.fit(docs, known)).count() == 0
