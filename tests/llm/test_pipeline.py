import random

import corpus_pipeline as c
from plumbrow.llm.common import cut
from tests.llm.test_linededup import brute
from tests.llm.test_simhash import brute_components, brute_print

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_names_and_order():
    assert [f.__name__ for _, f in c.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "mixture"]
    assert c.ORACLE_SQL is None


def test_stages_on_planted_cases(spark, sf_dir, documents, texts):
    """Each stage's decisions on its own input: what is planted goes, what is clean stays."""
    rnd = random.Random(7)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    fresh = lambda n: " ".join("".join(rnd.choice("bcdfghlmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n))
    originals = [fresh(150) for _ in range(20)]
    near = []
    for t in originals:
        w = t.split()
        w[70] = "edited"
        near.append(" ".join(w))
    line = fresh(8)
    planted = {
        **{10_000 + i: t for i, t in enumerate(originals)}, **{11_000 + i: t for i, t in enumerate(originals)},
        **{12_000 + i: t for i, t in enumerate(near)}, 13_000: fresh(30) + "\n" + item + "\n" + fresh(30),
        13_001: fresh(40) + "\n" + line, 13_002: line + "\n" + fresh(40), 13_003: "12345 !!", 13_004: None, 13_005: "",
    }
    rows = [(i, t, None, "planted", len(t or "")) for i, t in planted.items()]
    docs = documents.select(*c.COLUMNS).unionByName(spark.createDataFrame(rows, DOCS))

    def step(f, docs):
        out = cut(f(spark, docs, sf_dir), "stage")
        return out, {r.doc_id: r for r in out.collect()}

    before = set(texts) | set(planted)
    docs, kept = step(c.language, docs)
    assert docs.columns == list(c.COLUMNS) and before - set(kept) == {13_003, 13_004, 13_005}
    assert all(r.lang for r in kept.values())

    want = {i: kept_text for i, _, _, kept_text, _ in brute([(i, r.text) for i, r in kept.items()])}
    docs, deduped = step(c.line_dedup, docs)
    assert docs.columns == list(c.COLUMNS) and {i: r.text for i, r in deduped.items()} == want
    assert line in want[13_001] and line not in want[13_002] and want[11_000] == ""

    docs, single = step(c.near_dedup, docs)
    assert docs.columns == list(c.COLUMNS)
    groups = brute_components([(i, brute_print(r.text)) for i, r in deduped.items()])
    assert set(single) == {i for i, _, component in groups if i == component}
    assert 0 < sum(12_000 + i not in single for i in range(20)) and all(10_000 + i in single for i in range(20))

    docs, clean = step(c.decontamination, docs)
    assert docs.columns == list(c.COLUMNS) and 13_000 in single and 13_000 not in clean
    assert all(item not in (r.text or "") for r in clean.values()) and len(clean) > 0.9 * len(single)

    _, mixed = step(c.mixture, docs)
    assert all(r.rate > 0 and r.text == clean[i].text for i, r in mixed.items())
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()
    good = {r.doc_id for r in good} & set(clean)  # a classifier of so few labels may take one for toxic
    assert len(good) > 20 and len(good & set(mixed)) >= 0.95 * len(good)
    assert len(mixed) > 0.8 * len(clean)


def test_rows_without_ids_and_empty_tables(spark, sf_dir):
    rows = [(None, "one text that is here", "en", None, None), (None, "one text that is here", "en", None, None), (None, "another text of words", "en", "a", 3),
            (5, "same id twice in a row", None, "a", 1), (5, "same id twice in a row", None, "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = c.near_dedup(spark, docs, sf_dir).collect()
    assert sorted(r.text for r in kept) == ["another text of words", "one text that is here", "same id twice in a row"]
    assert c.decontamination(spark, docs, sf_dir).count() == 5
    assert c.language(spark, docs, sf_dir).count() == 5
    empty = docs.filter("false")
    for _, stage in c.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_is_the_stages_in_order(spark, sf_dir, texts):
    out = c.run(spark, sf_dir)
    assert set(out.columns) >= {*c.COLUMNS, "rate", "copies"}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= set(texts) and len(ids) > len(texts) / 2
