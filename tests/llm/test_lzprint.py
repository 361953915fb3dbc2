import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from plumbrow.llm import lzprint
from plumbrow.llm.queries import QUERIES


def brute_phrases(text):
    """Sets of texts, one character at a time."""
    seen, i = set(), 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in seen:
            j += 1
        seen.add(text[i:j])
        i = j
    return seen


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abä漢 \n", max_size=200), st.text(max_size=60))
def test_phrases_and_shared_beginnings(text, other):
    codes, ends = lzprint.codes_of(text), []
    lzprint.parse(codes.tolist(), 21, {}, ends)
    bounds = [0, *ends] + ([len(text)] if (ends[-1] if ends else 0) < len(text) else [])
    assert {text[a:b] for a, b in zip(bounds, bounds[1:])} == brute_phrases(text)
    new = lzprint.edited(text, other)
    own, changed = lzprint.both_fingerprints(text, new)
    assert (own == lzprint.fingerprint(text)).all() and (changed == lzprint.fingerprint(new)).all()


def test_likeness_estimates_the_share_of_common_phrases(texts):
    pairs = [(a, lzprint.edited(a, b)) for a, b in zip(list(texts.values())[:60], list(texts.values())[1:])]
    errors = []
    for a, b in pairs:
        x, y = brute_phrases(a), brute_phrases(b)
        errors.append(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - len(x & y) / max(1, len(x | y)))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3


def check(df, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        new = lzprint.edited(a, b)
        p, e, n = lzprint.fingerprint(a), lzprint.fingerprint(new), lzprint.fingerprint(b)
        sha = hashlib.sha256(new.encode()).hexdigest()
        want.append((i, len(a), sha, lzprint.as_text(p), lzprint.as_text(e), lzprint.likeness(p, e), lzprint.likeness(p, n)))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_query_against_brute_force(spark, sf_dir, texts):
    got = QUERIES["op3_document_fingerprints"](spark, sf_dir)
    check(got, list(texts.items()))
    assert np.mean([r.near_edited > r.near_next for r in got.collect()]) > 0.95


def test_odd_texts(make_docs):
    rows = [(4, "abcabcabcabc"), (2, None), (9, ""), (7, "漢字😀" * 9), (7, "漢字😀" * 9), (3, "x"), (1, "z" * 50_000), (None, "no id"), (8, "ab")]
    check(lzprint.with_next(make_docs(rows)), rows)
    check(lzprint.with_next(make_docs([(1, "only one row")])), [(1, "only one row")])
    check(lzprint.with_next(make_docs([(1, "bb"), (1, "aaaa"), (1, "cccc dddd")])), [(1, "bb"), (1, "aaaa"), (1, "cccc dddd")])
    assert lzprint.with_next(make_docs([])).count() == 0
    assert lzprint.edited("abcdefgh", "XY") == "abcdefXY" and lzprint.edited("abcdefgh", "Z") == "abcdefZ"
