import random
from itertools import combinations

import pytest

from plumbrow.llm import jaccard
from plumbrow.llm.queries import ORACLES, QUERIES
from tests.compare import differences


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=80):
    """``rows``: (id, text); (id, size, smallest id that links lead to), from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str((i, len(sets[k]), least.get(find(k)))) for k, (i, _) in enumerate(rows)))


def got(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"edit{rnd.randrange(10**9)}"
    return out


def fresh(rnd, n, kind="w"):
    return [f"{kind}{rnd.randrange(10**6)}" for _ in range(n)]


def test_query_against_sql(spark, sf_dir, duck):
    assert differences(QUERIES["op13_ngram_jaccard_join"](spark, sf_dir), duck, ORACLES["op13_ngram_jaccard_join"]) is None


@pytest.fixture(scope="module")
def planted():
    """Pairs about the threshold, chains, hubs, parts of one another, texts that are mostly a shared passage, short texts."""
    rnd = random.Random(3)
    texts = []
    for k in range(80):  # 3 to 9 edits of 200 words: similarities from 0.63 to 0.87
        w = fresh(rnd, 200)
        texts += [w, edited(rnd, w, 3 + k % 7)]
    for size in (9, 10, 11, 13, 24, 44, 45, 46):  # exactly 0.8 and next to it, by length
        w = fresh(rnd, size)
        texts += [w, w[: (size - 4) * 4 // 5 + 4], w[: (size - 4) * 4 // 5 + 3], [*w, "more"], edited(rnd, w, 1)]
    chain = fresh(rnd, 150)
    for _ in range(25):
        texts.append(chain)
        chain = edited(rnd, chain, 2)
    for _ in range(3):  # copies of copies about one text: many are similar to a few only
        hub = fresh(rnd, 200, "h")
        texts += [edited(rnd, hub, rnd.choice([2, 3, 4])) for _ in range(40)]
    passage = fresh(rnd, 60, "p")
    texts += [fresh(rnd, n) + passage + fresh(rnd, n) for n in [0, 1, 2, 3, 5, 8, 20, 60] for _ in range(8)]
    texts += [fresh(rnd, 1) * k for k in (1, 4, 5, 6, 300)]
    rows = list(enumerate(" ".join(t) for t in texts))
    rows += [(900 + i, t) for i, t in enumerate([None, "", " \n", "one", "One", "ÄB", "äb", "a b", "a  b", "x " * 9000, "x " * 800, "a b c d e", "A b c d e f"])]
    rows += [rows[0], (1, "another text of the same id"), (None, rows[2][1]), (None, "no id at all"), (None, None)]
    rnd.shuffle(rows)
    return rows, brute(rows)


@pytest.mark.parametrize("hot_from", [2, 5, 256])
def test_planted_texts(make_docs, planted, hot_from):
    rows, want = planted
    assert got(jaccard.similar_documents(make_docs(rows), hot_from=hot_from)) == want


def test_other_thresholds(make_docs):
    rnd = random.Random(8)
    base = [fresh(rnd, 60) for _ in range(12)]
    rows = list(enumerate(" ".join(t) for w in base for t in [w, *(edited(rnd, w, k) for k in range(1, 8))]))
    for percent in (50, 95, 100):
        assert got(jaccard.similar_documents(make_docs(rows), percent=percent)) == brute(rows, percent)


def test_empty_table(make_docs):
    assert jaccard.similar_documents(make_docs([])).count() == 0
    assert got(jaccard.similar_documents(make_docs([None, ""]))) == brute([(0, None), (1, "")])


def test_pairs_follow_the_documents(make_docs, monkeypatch):
    """Texts with half a passage in common, and near copies of one text of which a third are similar to few others."""
    rnd = random.Random(5)
    passage, hub = fresh(rnd, 70, "p"), fresh(rnd, 150, "h")
    texts = [passage + fresh(rnd, 60) for _ in range(150)]
    texts += [edited(rnd, hub, rnd.choice([1, 2, 4])) for _ in range(150)]
    rows = list(enumerate(" ".join(t) for t in texts))
    rnd.shuffle(rows)
    written, cut = [], jaccard.cut

    def counted(df, label):
        out = cut(df, label)
        if "pairs" in label:
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    assert got(jaccard.similar_documents(make_docs(rows))) == brute(rows)
    assert 0 < sum(written) <= 30 * len(rows), written
