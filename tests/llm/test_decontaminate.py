import random
import re
import string

import numpy as np

from plumbrow.llm import decontaminate as d
from plumbrow.llm.queries import QUERIES


def plain(text):
    return re.sub(f"[{re.escape(string.punctuation)}]", " ", (text or "").lower()).split()


def brute_alignment(a, b):
    """Best local score, cell by cell."""
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(max(0, above[j] + (d.MATCH if x == y else d.MISMATCH), above[j + 1] + d.GAP, here[j] + d.GAP))
        best, above = max(best, *here), here
    return best


def test_alignment_against_every_cell():
    rnd = np.random.default_rng(4)
    a = [rnd.integers(0, 4, rnd.integers(1, 12)) for _ in range(80)]
    b = [rnd.integers(0, 4, rnd.integers(0, 20)) for _ in range(80)]
    assert d.smith_waterman(a, b).tolist() == [brute_alignment(x, y) for x, y in zip(a, b)]


def test_query_finds_what_a_full_alignment_finds(spark, sf_dir, texts):
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op8_benchmark_decontamination"](spark, sf_dir).collect()}
    words = {i: plain(t) for i, t in texts.items()}
    verbatim = {
        (i, k) for i, w in words.items() for k, x in items.items() if f" {' '.join(x)} " in f" {' '.join(w)} "
    }
    assert verbatim and verbatim <= set(got) and all(got[p] == 1.0 for p in verbatim)
    for (i, k), score in got.items():  # no higher than the whole text gives
        assert 0.5 <= score <= brute_alignment(items[k], words[i]) / (2 * len(items[k])) + 1e-9


def test_planted_copies(spark, make_docs):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    passage = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [passage(30) for _ in range(8)] + [passage(200), ["two", "words"], [], ["Three", "short", "words"]]
    edited = list(items[1])
    for at in (4, 9, 15, 24):
        edited[at] = "changed"
    dropped = [w for i, w in enumerate(items[2]) if i not in (7, 8, 20)]
    common = " ".join(items[3])  # in most documents: its runs of words are frequent, and still seeds
    texts = {
        0: " ".join(passage(300)), 1: " ".join(passage(50) + items[0] + passage(50)), 2: " ".join(passage(9) + edited),
        3: ". ".join(dropped + passage(20)).upper(), 4: None, 5: "", 6: " ".join(items[8][100:170]), 7: "two words",
        8: "x, three short WORDS! y", 9: " ".join(passage(20_000) + items[4]), 10: " ".join(items[5][:10]),
        **{100 + i: " ".join(passage(5)) + " " + common for i in range(60)},
    }
    rows = list(texts.items()) + [(None, " ".join(items[6])), (1, texts[1])]
    bench = spark.createDataFrame([(i, " ".join(x), "z") for i, x in enumerate(items)], "item_id bigint, text string, words string")
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(make_docs(rows), bench).collect()}
    want = {(1, 0), (2, 1), (3, 2), (6, 8), (9, 4), (8, 11), (None, 6)} | {(100 + i, 3) for i in range(60)}
    assert set(got) == want
    assert got[1, 0] == got[100, 3] == 1.0 and got[2, 1] == (26 * 2 - 4) / 60
    assert d.contaminated(make_docs([]), bench).count() == 0
    assert d.contaminated(make_docs(rows), bench.filter("false")).count() == 0


def test_copies_with_an_edit_every_few_words(spark, make_docs):
    """Against brute-force alignment; other documents hold runs of the items too, so that no run is rare by itself."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    passage = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [passage(rnd.randrange(15, 60)) for _ in range(24)]
    texts = []
    for k, item in enumerate(items):
        step, first = 4 + k % 3, k % 4
        copy = [f"edit{i}" if i % step == first else w for i, w in enumerate(item)]
        texts.append(passage(20) + copy + passage(20))
    for item in items:  # fragments that are no copies
        at = rnd.randrange(len(item) - 3)
        texts.append(passage(15) + item[at : at + 3] + passage(15))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(make_docs([" ".join(t) for t in texts]), bench).collect()}
    scores = {(i, k): brute_alignment(x, t) / (2 * len(x)) for i, t in enumerate(texts) for k, x in enumerate(items)}
    assert got == {p: s for p, s in scores.items() if s >= 0.5}
    assert len(got) >= 20


def bench_of(spark, items):
    return spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")


def test_frequent_runs_are_no_seeds(spark):
    rnd = random.Random(3)
    grams = [(g, c) for c in range(12) for g in rnd.sample(range(60), 3 + 4 * c)]
    hits = [rnd.randrange(45) for _ in range(400)]
    seeds = d.rare_seeds(spark.createDataFrame(grams, "gram long, chunk long"), spark.createDataFrame([(h,) for h in hits], "gram long"))
    want = set()
    for c in range(12):
        own = sorted((g for g, x in grams if x == c), key=lambda g: (-hits.count(g), g))
        want |= {(g, c) for g in own[len(own) // d.FREQUENT :] if g in hits}
    assert {(r.gram, r.chunk) for r in seeds.collect()} == want


def test_items_that_begin_alike_do_not_meet_all_documents(spark, make_docs, monkeypatch):
    rnd = random.Random(5)
    passage = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    items = [["which", "of", "the", "following"] + passage(14) for _ in range(400)]
    texts = [" ".join(passage(5) + ["which", "of", "the"] + passage(5)) for _ in range(2000)]
    texts += [" ".join(passage(5) + x) for x in items[:20]]
    pairs, aligned = [], d._aligned
    monkeypatch.setattr(d, "_aligned", lambda rows, threshold: pairs.append(rows.count()) or aligned(rows, threshold))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(make_docs(texts), bench_of(spark, items)).collect()}
    assert got == {(2000 + k, k) for k in range(20)} and pairs[0] < 1000


def test_copies_across_borders_of_long_items(spark, make_docs):
    rnd = random.Random(6)
    passage = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    items = [passage(n) for n in (64, 127, 128, 191, 400)]
    starts = [(k, s) for k, x in enumerate(items) for s in {0, 31, 48, 96, len(x) // 2, len(x) - 64} if 0 <= s <= len(x) - 64]
    texts = [" ".join(passage(30) + items[k][s : s + 64] + passage(30)) for k, s in starts]
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(make_docs(texts), bench_of(spark, items)).collect()}
    assert set(got) == {(i, k) for i, (k, _) in enumerate(starts)}
    assert all(score >= 0.7 for (_, k), score in got.items() if k > 1)


def test_recall_of_random_edits(spark, make_docs):
    """Against full alignment, with one word in three, four, six or ten changed, dropped or added, and every phrase common."""
    rnd = random.Random(8)
    phrases = [[f"w{rnd.randrange(300)}" for _ in range(4)] for _ in range(150)]
    passage = lambda n: sum((rnd.choice(phrases) for _ in range(n // 4)), [])
    items, texts = [passage(rnd.randrange(16, 64)) for _ in range(40)], []
    for item in items:
        for rate in (3, 4, 6, 10):
            edits = (rnd.choice(([], ["x"], ["x", w])) if rnd.randrange(rate) == 0 else [w] for w in item)
            texts.append(passage(20) + sum(edits, []) + passage(20))
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(make_docs([" ".join(t) for t in texts]), bench_of(spark, items)).collect()}
    scores = {}
    for k, item in enumerate(items):
        number = {w: n for n, w in enumerate(dict.fromkeys(item))}
        full = d.smith_waterman([np.array([number[w] for w in item])] * len(texts), [np.array([number.get(w, -5) for w in t]) for t in texts])
        scores |= {(i, k): s / (2 * len(item)) for i, s in enumerate(full.tolist()) if s >= len(item)}
    assert all(got[p] == scores[p] for p in got)
    assert len(scores) >= 100 and len(got) >= 0.97 * len(scores)
