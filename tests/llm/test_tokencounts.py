import shutil
from collections import Counter

from pyspark.sql import functions as F

from plumbrow.llm import tokencounts as t
from plumbrow.llm.queries import QUERIES

FILES = {"v1": f"{t.VOCABULARIES}/byte_bpe_50k.tiktoken", "v2": f"{t.VOCABULARIES}/byte_bpe_multi_50k.tiktoken"}


def coders():
    return {name: t.encoding(name, open(path, "rb").read()) for name, path in FILES.items()}


def test_query_against_counts_of_the_final_state(spark, sf_dir, documents):
    coder, seen, want = coders(), set(), Counter()
    for r in documents.orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            version = "v1" if r.lang == "en" else "v2"
            want[r.source, r.lang, version, "n"] += 1
            want[r.source, r.lang, version, "t"] += len(coder[version].encode_ordinary(r.text))
    got = Counter()
    for r in QUERIES["op9_token_counts"](spark, sf_dir).collect():
        got[r.source, r.lang, r.tokenizer, "n"] += r.documents
        got[r.source, r.lang, r.tokenizer, "t"] += r.tokens
    assert got == want


def test_counts_of_odd_texts(spark, make_docs):
    texts = [None, "", "plain words", "<|endoftext|> 漢字 😀", "x" * 50_000, (7, "again"), (7, "again")]
    coder = coders()
    got = t.count_tokens(make_docs(texts), FILES).collect()
    by_id = {r.doc_id: r.tokens for r in got}
    assert len(got) == 7 and by_id[0] == by_id[1] == {"v1": 0, "v2": 0}
    assert all(by_id[i][v] == len(coder[v].encode_ordinary(texts[i])) for i in (2, 3, 4) for v in FILES)
    assert got[0].f0 == 7 and "text" not in got[0].asDict()
    assert t.count_tokens(make_docs([]), FILES).count() == 0
    clash = make_docs(["plain words"]).withColumnRenamed("f0", "Tokens")
    assert t.count_tokens(clash, FILES).first().tokens == by_id[2]


def rows_of(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_batches_commit_once_and_add_up(spark, tmp_path):
    rollup = t.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    make = lambda *rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, documents bigint, tokens bigint")
    load = make(("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 7), ("b", "en", "v1", 1, None))
    assert rollup.commit("1", load) and not rollup.commit("1", load)
    first = {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 7), ("b", "en", "v1"): (1, 0)}
    assert rows_of(rollup) == first
    # A commit that broke off left files, but no mark: it does not count, and the retry replaces it.
    broken = tmp_path / "rollup" / "batch=2"
    load.write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert rows_of(rollup) == first and rollup.batches() == ["1"]
    assert rollup.commit("2", make(("a", "en", "v1", -1, -5), ("a", "en", "v2", 1, 6), ("b", "en", "v1", -1, 0)))
    assert rows_of(rollup) == {("a", "en", "v1"): (1, 10), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 7)}
    assert rollup.commit("3", load.filter("false")) and len(rows_of(t.Rollup(spark, str(tmp_path / "rollup")))) == 3


def test_of_two_committers_the_first_stands(spark, tmp_path):
    """Both found the id missing and wrote; then one after the other takes the name."""
    rollup = t.Rollup(spark, str(tmp_path / "rollup"))
    make = lambda n: spark.createDataFrame([("a", "en", "v1", 1, n)], t.Rollup._SCHEMA)
    for name, n in (("_writing-a", 10), ("_writing-b", 99)):
        make(n).write.parquet(str(tmp_path / "rollup" / name))
    assert rollup.totals().count() == 0
    assert rollup._named("_writing-a", "x") and not rollup._named("_writing-b", "x")
    assert rows_of(rollup) == {("a", "en", "v1"): (1, 10)} and rollup.batches() == ["x"]
    assert not (tmp_path / "rollup" / "_writing-b").exists() and not (tmp_path / "rollup" / "batch=x" / "_writing-b").exists()


def test_compacted_batches_stay_committed(spark, tmp_path):
    folder = tmp_path / "rollup"
    rollup = t.Rollup(spark, str(folder))
    rollup.compact()
    make = lambda *rows: spark.createDataFrame(rows, t.Rollup._SCHEMA)
    for k in range(4):
        assert rollup.commit(str(k), make(("a", "en", "v1", 1, k), (None, None, "v1", 1, 1)))
    kept = folder / "kept"
    shutil.copytree(folder / "batch=2", kept)
    want = {("a", "en", "v1"): (4, 6), (None, None, "v1"): (4, 4)}
    rollup.compact()
    assert rows_of(rollup) == want and rollup.batches() == ["0", "1", "2", "3"] and not list(folder.glob("batch=*"))
    assert not rollup.commit("2", make(("a", "en", "v1", 1, 100)))
    # A folder that a broken compaction did not come to delete counts once.
    shutil.copytree(kept, folder / "batch=2")
    assert rows_of(rollup) == want and rollup.batches() == ["0", "1", "2", "3"]
    assert rollup.commit("4", make(("a", "en", "v1", -4, -6)))
    rollup.compact()
    assert rows_of(t.Rollup(spark, str(folder))) == {(None, None, "v1"): (4, 4)} and rollup.batches() == ["0", "1", "2", "3", "4"]


def test_signed_changes(spark):
    df = spark.createDataFrame([("a", "en", {"v1": 3}), ("a", None, None)], "source string, lang string, tokens map<string,bigint>")
    got = t.change(df, "v1", -1, F.col("source") == "a").collect()
    assert sorted((r.documents, r.tokens) for r in got) == [(-1, -3), (-1, 0)]


def test_query_counts_null_texts(spark, tmp_path):
    rows = [(1, None, "en", "a"), (2, None, "en", "a"), (3, "same", "en", "a"), (4, "same", "en", "a"),
            (5, None, "de", "only nulls"), (6, "", "de", "a"), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()}
    n = len(coders()["v1"].encode_ordinary("same"))
    assert got == {("a", "en", "v1"): (3, n), ("only nulls", "de", "v2"): (1, 0), ("a", "de", "v2"): (1, 0), (None, None, "v2"): (1, 0)}
