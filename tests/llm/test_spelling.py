import random
import re
import zlib
from collections import Counter

from plumbrow.llm import spelling
from plumbrow.llm.queries import QUERIES

A_Z = {c: c + 32 for c in range(65, 91)}


def brute_counts(texts, shortest=5, least=3):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= least and len(w) >= shortest}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    words, near, form = sorted(counts), {}, {}
    for a in words:
        near[a] = [b for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)]
        if near[a]:
            best = min(near[a], key=lambda b: (-counts[b], b))
            if counts[best] >= 2 * counts[a]:
                form[a] = best
    out = []
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, counts[a], len(near[a]), counts.get(form.get(a))))
    return out


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_against_brute_force(spark, sf_dir, texts):
    want = brute_variants(brute_counts(texts.items()))
    got = QUERIES["op11_spelling_variants"](spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == sorted(want)
    assert any(w[1] for w in want) and any(w[2] != w[1] for w in want if w[1])


def test_words_that_repeat_letters_or_share_all_grams(spark):
    """Few letters, so that words are dense, grams frequent and bounds low; ties; chains of forms; very long words."""
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(900)}
    words |= {"a" * k for k in range(1, 30)} | {"x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2500, "ab" * 700, "ab" * 700 + "a"}
    words |= {"chain" + "z" * k for k in range(12)} | {"ß" * 5, "ÿ" * 5, "ß" * 4 + "ÿ"}
    counts = {w: rnd.choice([3, 3, 4, 6, 9, 50, 1000]) for w in sorted(words)}
    counts |= {"chain" + "z" * k: 3 * 2**k for k in range(12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)
    want = sorted(brute_variants(counts))
    for frequent in (0, 5, 10**6):
        assert rows_of(spelling.variants(df, frequent=frequent)) == want
    assert next(w for w in want if w[0] == "chain")[2] == "chain" + "z" * 11


def test_bounds_hold(spark):
    """A near word keeps at least as many grams of a word, one place on at most, as the bound says."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 10))) for _ in range(300)]
    counts = Counter(w[p : p + k] for w in (f"\x02{w}\x03" for w in words) for k in range(2, 5) for p in range(len(w) - k + 1))

    def grams(word, frequent):
        marked = f"\x02{word}\x03"
        known = {(p, k): counts[marked[p : p + k]] for k in range(1, 5) for p in range(len(marked) - k + 1)}
        found = spelling.grams_of(marked, known, frequent)
        return [(p, marked[p : p + k]) for p, k in found], len(found) - spelling.affected(marked, found, known, frequent)

    for _ in range(3000):
        w, frequent = rnd.choice(words), rnd.choice([2, 10, 40, 200])
        i, c = rnd.randrange(len(w)), rnd.choice("abcd")
        other = rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c])
        (mine, bound), (theirs, _) = grams(w, frequent), grams(other, frequent)
        shift = len(other) - len(w)
        assert sum((p, g) in theirs or (p + shift, g) in theirs for p, g in mine) >= bound


def test_odd_texts(spark, make_docs):
    odd = [None, "", " 12 ", "Abcde ABCDE abcde", "abcdf", "abcdf abcdf", "ÀÉÎ×÷ àéî×÷ ÀÉÎ×÷ ÀÉÎ×÷", "Ābcdef" * 3, (None, "abcde"), (7, "abcde"), (7, "abcde"), "word" * 40_000]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(odd)]
    counts = brute_counts(rows)
    assert rows_of(spelling.variants(spelling.word_counts(make_docs(rows)))) == sorted(brute_variants(counts))
    assert "abcde" in counts and "àéî×÷" not in counts
    empty = spelling.word_counts(make_docs([]))
    assert empty.count() == 0 and spelling.variants(empty).count() == 0
    nulls = spark.createDataFrame([(None, 5), ("words", 5)], "word string, n bigint")
    assert spelling.variants(nulls).count() == 2
