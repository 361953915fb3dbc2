import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from pairs of an id and a text; with columns whose names the operators use inside."""

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        full = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", f0 int, id string").coalesce(2)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """Texts by id."""
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").orderBy("doc_id").collect()}
