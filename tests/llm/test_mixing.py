import numpy as np
import pytest

from plumbrow.llm import mixing
from plumbrow.llm.queries import DOMAIN_SHARES, QUERIES


def test_query_meets_its_targets(spark, sf_dir, texts):
    rows = QUERIES["op4_mixing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    t, rate, p = (np.array(x) for x in zip(*((r.tokens, r.rate, r.posteriors) for r in rows)))
    assert [r.tokens for r in rows] == [len(texts[r.doc_id].split()) for r in rows]
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1)
    got = (t * rate) @ p / t.sum()
    assert got == pytest.approx([DOMAIN_SHARES[n] for n in ("high", "low", "toxic")], rel=0.02, abs=0.003)
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r.tokens
    for s, share in mixing.tempered(totals).items():
        reached = sum(r.tokens * r.rate for r in rows if r.source == s) / t.sum()
        assert reached == pytest.approx(share, rel=0.02)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)
    assert sum(r.copies for r in rows) == pytest.approx(rate.sum(), rel=0.1)


def test_rates_are_the_projected_least_squares(spark):
    """Against plain projected gradients over all documents in one array."""
    rnd = np.random.default_rng(3)
    n = 60
    p = rnd.dirichlet([0.5, 0.5, 0.5], n)
    tokens = rnd.integers(1, 500, n)
    sources = ["a" if i % 3 else "b" if i % 2 else None for i in range(n)]
    rows = [(s, int(t), [float(x) for x in q]) for s, t, q in zip(sources, tokens, p)]
    members = spark.createDataFrame(rows, "source string, tokens bigint, posteriors array<double>").repartition(3)
    domains, shares = {"x": 0.7, "y": 0.3, "z": 0.0}, {"a": 0.2, "b": 0.6}
    fit = mixing.fit_rates(members, ["x", "y", "z"], domains, shares, ridge=0.05, rounds=150, close=0)
    got = {r.posteriors[0]: r.rate for r in mixing.rated(members, ["x", "y", "z"], shares, fit).collect()}
    m = np.concatenate([p, np.array([[s == "a", s == "b"] for s in sources], float)], axis=1)
    named = tokens[[s is not None for s in sources]].sum()
    target = np.array([0.7 * tokens.sum(), 0.3 * tokens.sum(), 0.0, 0.2 * named, 0.6 * named])
    scale = np.maximum(target, 0.01 * tokens.sum())
    rate = np.ones(n)
    step = 1 / (np.linalg.eigvalsh((m * tokens[:, None]).T @ m / np.sqrt(np.outer(scale, scale)))[-1] + 0.05)
    for _ in range(60_000):
        rate = np.maximum(0, rate - step * (m @ (((tokens * rate) @ m - target) / scale) + 0.05 * (rate - 1)))
    loss = lambda r: (((tokens * r) @ m - target) ** 2 / scale).sum() + 0.05 * (tokens * (r - 1) ** 2).sum()
    ours = np.array([got[float(q[0])] for q in p])
    assert (ours >= 0).all() and loss(ours) <= loss(rate) * 1.02
    assert len(fit.gradients) == 150 and fit.reached == pytest.approx((tokens * ours) @ m)


def random_members(spark, n, sources):
    rnd = np.random.default_rng(7)
    p, tokens = rnd.dirichlet([0.5, 0.5, 0.5], n), rnd.integers(1, 500, n)
    of = [f"s{int(x)}" for x in (rnd.random(n) ** 3) * sources]
    rows = [(s, int(t), [float(x) for x in q]) for s, t, q in zip(of, tokens, p)]
    return p, tokens, of, spark.createDataFrame(rows, "source string, tokens bigint, posteriors array<double>")


def test_step_is_that_of_the_largest_eigenvalue_or_little_less(spark):
    p, tokens, of, members = random_members(spark, 300, 12)
    names = sorted(set(of))
    fit = mixing.fit_rates(members, ["x", "y", "z"], {"x": 0.8, "y": 0.2}, dict.fromkeys(names, 1 / len(names)), rounds=0)
    m = np.concatenate([p, np.array([[s == x for x in names] for s in of], float)], axis=1)
    scale = np.maximum(fit.targets, mixing.SMALLEST * tokens.sum())
    largest = np.linalg.eigvalsh((m * tokens[:, None]).T @ m / np.sqrt(np.outer(scale, scale)))[-1]
    assert 0.8 <= fit.step * (largest + fit.ridge) <= 1 + 1e-9
    assert set(mixing.missed(fit)) <= set(fit.names) and "domain:x" in mixing.missed(fit)


def test_many_sources(spark):
    """Nothing grows with the square of the targets: 8,000 sources would make 512 MB of it."""
    p, tokens, of, members = random_members(spark, 12_000, 8000)
    totals = {}
    for s, t in zip(of, tokens.tolist()):
        totals[s] = totals.get(s, 0) + t
    shares = mixing.tempered(totals, 0.8)
    fit = mixing.fit_rates(members, ["x", "y", "z"], {"x": 0.4, "y": 0.3, "z": 0.3}, shares, rounds=12)
    start = np.concatenate([tokens @ p, [totals[s] for s in shares]])
    scale = np.maximum(fit.targets, mixing.SMALLEST * tokens.sum())
    loss = lambda at: (((at - fit.targets) ** 2) / scale).sum()
    assert loss(fit.reached) < 0.5 * loss(start)


def test_targets_that_cannot_be_met_are_told(spark, make_docs, caplog):
    docs = make_docs([(i, "nice words " * 3) for i in range(8)])
    labels = spark.createDataFrame([(i, "good") for i in range(8)], "doc_id bigint, domain string")
    with caplog.at_level("WARNING"):
        rows = mixing.mix(docs, labels, {"good": 1.0}, {"nowhere": 1.0}).collect()
    assert len(rows) == 8 and "nowhere" not in caplog.text
    members = spark.createDataFrame([("a", 10, [1.0])], "source string, tokens bigint, posteriors array<double>")
    fit = mixing.fit_rates(members, ["x"], {"x": 1.0}, {"a": 0.5, "b": 0.5}, rounds=30)
    assert set(mixing.missed(fit)) >= {"source:b"}


def test_odd_tables(spark, make_docs):
    labels = [(0, "good"), (1, "bad"), (2, None), (99, "good"), *((i, ("good", "bad")[i % 2]) for i in range(20, 30))]
    labels = spark.createDataFrame(labels, "doc_id bigint, domain string")
    more = [(i, ("nice words here", "BAD!! BAD!!")[i % 2]) for i in range(20, 30)]
    docs = make_docs(["nice words here " * 5, "BAD!! BAD!! " * 5, None, "", (7, "same row"), (7, "same row"), (None, "no id"), (8, "long " * 20_000), *more])
    docs = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id = 8 THEN NULL ELSE source END AS source", "n_chars", "f0")
    got = mixing.mix(docs, labels, {"good": 0.9, "bad": 0.1}, carry=("n_chars",)).collect()
    assert len(got) == 18 and all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in got)
    assert {r.doc_id: r.tokens for r in got}[2] == 0 and {r.carried.n_chars for r in got if r.doc_id == 8} == {100_000}
    assert len({r.rate for r in got if r.doc_id == 7}) == 1
    unlabelled = mixing.mix(docs, labels.filter("false"), {"good": 1.0}).collect()
    assert len(unlabelled) == 18 and all(r.posteriors == [] for r in unlabelled)
    assert mixing.mix(docs.filter("false"), labels, {"good": 1.0}).count() == 0
