"""The registered queries of the operators, and the SQL to compare where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrow.llm import decontaminate, jaccard, langid, licenses, linededup, lzprint, mixing, nbsvm, pseudonyms, simhash, spelling, tokencounts, vectorcodes
from plumbrow.llm.common import cut, remainder, table
from plumbrow.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


@query()
def op1_simhash_near_dedup(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_of("f0").alias("fingerprint"), "component_id")


@query()
def op3_document_fingerprints(spark, sf):
    return lzprint.with_next(table(spark, sf, "documents"))


DOMAIN_SHARES = {"high": 0.92, "low": 0.06, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from the table of labels: toxic texts, and others by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


@query()
def op4_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    mixed = mixing.mix(docs, domain_labels(table(spark, sf, "labels")), DOMAIN_SHARES)
    return mixed.select("doc_id", "source", "tokens", "posteriors", "rate", "copies")


# The key is a line stripped of the six ASCII white-space characters, A-Z in lower case.
_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query(_LINES)
def op5_line_dedup(spark, sf):
    found = linededup.dedup_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query()
def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query()
def op6_pii_pseudonyms(spark, sf):
    return pseudonyms.pseudonymize(table(spark, sf, "documents"), key="corpus-key-1")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: those under 100 characters in the folder of their source and language, others in
    folders of a thousand ids below it."""
    folder = F.concat_ws("/", "source", "lang")
    below = F.concat_ws("/", folder, F.floor(F.col("doc_id") / 1000).cast("string"))
    return docs.withColumn("path", F.concat_ws("/", F.when(F.length("text") < 100, folder).otherwise(below), "doc_id"))


@query()
def op7_license_scan(spark, sf):
    found = licenses.scan(document_paths(table(spark, sf, "documents")))
    return found.withColumn("doc_id", F.substring_index("path", "/", -1).cast("bigint"))


@query()
def op8_benchmark_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op9_token_counts(spark, sf):
    """All documents are loaded; then those not in English are counted anew with the vocabulary for many
    languages; then exact copies, all but the smallest id, are taken down."""
    docs = table(spark, sf, "documents")
    revise = ~F.col("lang").eqNullSafe("en")
    tokenizers = F.when(revise, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    wanted = docs.select("doc_id", "source", "lang", "text", tokenizers.alias("tokenizers"), F.sha2("text", 256).alias("sha"))
    vocabularies = {
        "v1": f"{tokencounts.VOCABULARIES}/byte_bpe_50k.tiktoken",
        "v2": f"{tokencounts.VOCABULARIES}/byte_bpe_multi_50k.tiktoken",
    }
    counted = cut(tokencounts.count_tokens(wanted, vocabularies), "token-counts")
    firsts = cut(counted.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "first-copies")
    # Null texts have no sha: they are no copies of each other, and stay.
    marked = cut(counted.join(firsts, "sha", "left").drop("sha"), "marked")
    rollup = tokencounts.Rollup(spark, new_path(spark, "rollup"))
    return tokencounts.maintained(marked, rollup, "v1", "v2", revise, F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))


@query()
def op10_quality_classifier(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = labels.filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = nbsvm.fit(docs, known)
    found = nbsvm.score(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query()
def op11_spelling_variants(spark, sf):
    return spelling.variants(spelling.word_counts(table(spark, sf, "documents")))


def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """Each round compares every part with every entry of its codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS (SELECT vec_id, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
  SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS distance
  FROM components c JOIN book{k} b ON c.part = b.part AND c.pos = b.pos GROUP BY ALL) GROUP BY vec_id, part)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(CAST(floor(m.total / m.n) AS BIGINT), b.x) AS x
  FROM book{k} b LEFT JOIN (SELECT n.part, n.entry, c.pos, CAST(sum(c.x) AS DOUBLE) AS total, count(*) AS n
    FROM near{k} n JOIN components c ON c.vec_id = n.vec_id AND c.part = n.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
            )
    return f"""
WITH kept AS (
  SELECT vec_id, label, len(embedding) // 4 AS width,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS (
  SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS x
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS (
  SELECT part, entry, pos, x FROM components JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


@query(_codes_sql())
def op12_vector_codes(spark, sf):
    return vectorcodes.encode(table(spark, sf, "embeddings")).drop("label")


_JACCARD = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(list_slice(words, i, i + 4), ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM cut WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)"""


@query(_JACCARD)
def op13_ngram_jaccard_join(spark, sf):
    return jaccard.similar_documents(table(spark, sf, "documents"))
