import itertools

import numpy as np

from plumbrow.llm import langid
from plumbrow.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf_dir).collect()}
    rows = documents.filter("lang is not null").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(got) == documents.count() and len(held) > 30
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_viterbi_against_all_paths():
    rnd = np.random.default_rng(2)
    lengths = np.array([3, 0, 6, 1, 5])
    scores = rnd.normal(size=(8, 3)) * 3
    ids = rnd.integers(0, 8, lengths.sum())
    path = langid.viterbi(scores, ids, lengths, switch=2.0)
    start = 0
    for n in lengths:
        own = ids[start : start + n]
        value = lambda p: sum(scores[w, s] for w, s in zip(own, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert abs(value(best) - value(path[start : start + n])) < 1e-9
        start += n


def test_spans_scripts_and_odd_texts(spark, make_docs):
    words = {"en": "the thing of that with which", "de": "die sache und das schön mit nicht", "ru": "это вещь которая была не так"}
    rows = [(i, (t + " ") * 20, lang) for i, (lang, t) in enumerate(words.items())]
    model = langid.fit(spark.createDataFrame(rows + [(9, None, "fr"), (10, "x", None)], "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed = words["en"] + " " + words["en"] + " " + words["ru"] + " " + words["de"] + " " + words["de"]
    texts = [mixed, None, "", "12 !! 3.4", "עברית בלבד", "The thing, 12 of THAT", (None, words["de"]), (15, "the"), (15, "the"), "the " * 20_000]
    got = langid.label_spans(make_docs(texts), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    assert [s.lang for s in by_id[0].spans] == ["en", "ru", "de"] and by_id[0].spans[1].words == 6
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert by_id[4].score == 0.0 and by_id[5].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert by_id[0].carried.id == "x" and by_id[9].spans[0].words == 20_000


def test_letters_are_those_of_unicode(make_docs):
    """Number signs are no letters; marks belong to their letter's word."""
    labelled = make_docs(["the thing of that with which " * 20]).unionByName(make_docs([(1, "हिन्दी में यह बात है " * 20)]).replace("en", "hi"))
    model = langid.fit(labelled)
    texts = ["10²", "½ ½", "①", "_", "हिन्दी", "\u0301", "é thing of that"]
    got = {r.doc_id: r for r in langid.label_spans(make_docs(texts), model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, []) for i in (0, 1, 2, 3, 5))
    assert got[4].lang_pred == "hi" and got[4].spans[0].words == 1
    assert got[6].lang_pred == "en" and got[6].spans[0].words == 4


def test_nothing_to_learn_from(make_docs):
    docs = make_docs(["a text", None])
    model = langid.fit(docs.filter("false"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("und", 0.0)}
    assert langid.predict(make_docs([]), langid.fit(docs)).count() == 0
