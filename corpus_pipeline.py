"""A training corpus from ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbrow.llm import common, decontaminate, langid, linededup, mixing, simhash
from plumbrow.llm.common import cut, table
from plumbrow.llm.queries import DOMAIN_SHARES, domain_labels
from plumbrow.sources import shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A text is rejected if no language holds so much of its letters.
LEAST_SHARE = 0.3
# Near copies: words of a shingle, and the bits in which their fingerprints differ at most.
NEAR = {"words": 3, "radius": 2}

_made_before: list[str] = []
_shared_before: list[Broadcast] = []


def _stage(f):
    """What a stage wrote and shared goes when the next one begins: by then its result has been written."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.drop(spark, _made_before)
        for value in _shared_before:
            value.destroy()
        with shared.recorded() as made, common.recorded() as sent:
            out = f(spark, docs, sf_dir)
        _made_before[:], _shared_before[:] = made, sent
        return out

    return stage


KEY = ("key", "key2")
MOST_BROADCAST = 400_000  # keys of documents that go: 10 MB; more meet the documents in a shuffle


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns, and 128 bits for each id and text, which rows that share an id or have none do not share."""
    keys: dict[str, Column] = {"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", "doc_id", F.lit("key2"))}
    return docs.select(*COLUMNS).withColumns(keys)


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go: null, empty, without letters, in scripts or mixtures that no learned language
    dominates. A missing language is filled in. If no document has a language, all stay."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if not model.langs:
        return docs
    found = langid.label_spans(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    lang = F.coalesce("carried.lang", "lang_pred").alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"carried.{c}").alias(c) for c in COLUMNS))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds go; a document keeps its row even if all its lines do."""
    kept = linededup.dedup_lines(docs, carry=("lang", "source"))
    return kept.select(
        "doc_id",
        F.col("kept").alias("text"),
        "carried.lang",
        "carried.source",
        F.length("kept").cast("bigint").alias("n_chars"),
    )


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; of rows with one id, or none, one of them."""
    rows = _keyed(docs)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    found = simhash.near_duplicates(numbered, **NEAR, doc_id="row", carry=("doc_id", *KEY))
    found = cut(found.select("component_id", "carried.*"), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)
    stay = cut(found.groupBy("component_id").agg(F.min(first).alias("first")).select("first.key", "first.key2"), "stay")
    gone = cut(found.join(stay, list(KEY), "left_anti").select(*KEY).distinct(), "gone")
    kept = rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, list(KEY), "left_anti")
    # Repeated rows share a key: one of them stays.
    times = found.join(stay, list(KEY), "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    repeated = cut(times.filter("n > 1").select(*KEY), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    one = F.row_number().over(Window.partitionBy(*KEY).orderBy("key"))
    again = kept.join(repeated, list(KEY), "left_semi").withColumn("copy_no", one).filter("copy_no = 1")
    return kept.join(repeated, list(KEY), "left_anti").select(*COLUMNS).union(again.select(*COLUMNS))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or edited parts of it, go."""
    rows = _keyed(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), doc_id="key")
    gone = cut(found.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return rows.join(gone, "key", "left_anti").select(*COLUMNS)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which they are to be seen, and that rate in whole copies; those of rate 0 go."""
    mixed = mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), DOMAIN_SHARES, carry=("text", "lang", "n_chars"))
    return mixed.filter("rate > 0").select(
        "doc_id", "carried.text", "carried.lang", "source", "carried.n_chars", "tokens", "posteriors", "rate", "copies"
    )


STAGES = [
    ("language", language),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]
ORACLE_SQL = None  # fingerprints, alignments and fitted models are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
