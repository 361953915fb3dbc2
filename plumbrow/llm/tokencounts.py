"""Token counts by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.llm.common import Batches, batches_of, share, text_of
from plumbrow.sources.files import current_version, materialize, read_stage

VOCABULARIES = "/opt/tokenizers"
# The pattern that cuts texts into words for the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ("source", "lang", "tokenizer")


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of a vocabulary, a few hundred kB, from any store that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def encoding(name: str, content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabularies: Mapping[str, str], text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``tokens``: a map from each tokenizer to the number of tokens, in place of a column of that name.

    ``vocabularies`` gives the file of each tokenizer version. If ``docs`` has a column ``tokenizers``, an
    array, only those named in a row are counted there. Strings of special tokens are ordinary text; a null text has none.
    """
    spark = docs.sparkSession
    shared = share(spark, {name: vocabulary(spark, path) for name, path in vocabularies.items()})
    others = [c for c in docs.columns if c.lower() not in (text.lower(), "tokenizers", "tokens")]  # a column tokens is replaced
    wanted = F.col("tokenizers") if "tokenizers" in docs.columns else F.array(*map(F.lit, vocabularies))
    rows = docs.select(text_of(text).alias("text"), wanted.alias("tokenizers"), F.struct(*others).alias("carried"))

    def counted(batches: Batches) -> Batches:
        coders = {name: encoding(name, content) for name, content in shared.value.items()}
        for batch in batches:
            maps = [
                [(name, len(coders[name].encode_ordinary(t))) for name in names or ()]
                for t, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(maps, pa.map_(pa.string(), pa.int64()))], ["carried", "tokens"]
            )

    carried = rows.schema["carried"].dataType.simpleString()
    return batches_of(rows, counted, f"carried {carried}, tokens map<string,bigint>").select("carried.*", "tokens")


class Rollup:
    """Additive totals in a folder: one small table of signed sums for each batch.

    A batch is a folder named after its id. It is written under a name of its own and takes the id's name in one step, complete or
    not at all; of several committers of one id the first stands. Committing an id again changes nothing, after ``compact`` too,
    so batches may be retried, and come in any order; the totals are those of all batches, whatever was
    deleted or revised in between. The step is a rename that fails where the name is taken, as on HDFS.
    """

    _SCHEMA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._base = f"{self.folder}/_compacted"

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _whole(self, batch: str) -> bool:
        store, path = self._path(f"batch={batch}/_SUCCESS")
        return store.exists(path)

    def _compacted(self) -> DataFrame | None:
        """The totals of compacted batches, and a row with each one's id: the table that ``compact`` wrote last."""
        return read_stage(self.spark, self._base) if current_version(self.spark, self._base) else None

    def _folders(self) -> list[str]:
        """Ids of the whole batches that have a folder and are not in the compacted table."""
        store, path = self._path("")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        found = [b for b in (n.removeprefix("batch=") for n in names if n.startswith("batch=")) if self._whole(b)]
        base = self._compacted()
        if found and base is not None:  # those that a compaction took in, but did not come to delete
            gone = {r.batch for r in base.filter(F.col("batch").isin(found)).select("batch").collect()}
            found = [b for b in found if b not in gone]
        return sorted(found)

    def committed(self, batch: str) -> bool:
        if self._whole(batch):
            return True
        base = self._compacted()
        return base is not None and not base.filter(F.col("batch") == batch).isEmpty()

    def batches(self) -> list[str]:
        """All committed ids."""
        base = self._compacted()
        old = [] if base is None else [r.batch for r in base.filter("batch IS NOT NULL").select("batch").collect()]
        return sorted([*old, *self._folders()])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes(source, lang, tokenizer, documents, tokens)``, signed, under an id; False if it was there.

        Sums are taken in each task before they move, so a source may hold any share of the rows.
        Null keys are a key of their own; null numbers count as 0.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs an id that can name a folder")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")))
        written = f"_writing-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{written}")
        return self._named(written, batch)

    def _named(self, written: str, batch: str) -> bool:
        """Give a written batch its name; False, and it is deleted, if another has it."""
        store, path = self._path(written)
        _, wanted = self._path(f"batch={batch}")
        if store.exists(wanted) and not self._whole(batch):  # without a mark: no batch, but what a broken write left
            store.delete(wanted, True)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            files.rename(store.makeQualified(path), store.makeQualified(wanted), options)
        except Py4JJavaError:
            if not self._whole(batch):
                raise
            store.delete(path, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches; keys whose sums are 0 are left out.

        All batches with a folder are one read, whatever their number; ``compact`` keeps it small.
        """
        return self._sums(self._folders(), self._compacted())

    def _sums(self, batches: Sequence[str], base: DataFrame | None) -> DataFrame:
        paths = [f"{self.folder}/batch={b}" for b in batches]
        parts = [self.spark.read.schema(self._SCHEMA).parquet(*paths)] if paths else []
        if base is not None:
            parts.append(base.filter("batch IS NULL").drop("batch"))
        if not parts:
            return self.spark.createDataFrame([], self._SCHEMA)
        total = reduce(DataFrame.union, parts).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens")))
        return total.filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Add the folders of all batches up into one table, which also keeps their ids.

        The table takes the place of the one before in one step; batches it holds do not count again, so it may break off
        at any point, and batches may be committed meanwhile. One compaction at a time; a read of the totals that
        runs meanwhile may miss its files and has to be made again, but none counts a batch twice.
        """
        taken, base = self._folders(), self._compacted()
        if not taken:
            return
        ids = self.spark.createDataFrame([(b,) for b in taken], "batch string")
        if base is not None:
            ids = ids.union(base.filter("batch IS NOT NULL").select("batch"))
        sums = self._sums(taken, base)  # of these batches only: others may come while it runs
        listed = ids.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in sums.schema.fields), "batch")
        materialize(sums.withColumn("batch", F.lit(None).cast("string")).unionByName(listed), self._base)
        for b in taken:
            store, path = self._path(f"batch={b}")
            store.delete(path, True)


def change(counted: DataFrame, tokenizer: str, sign: int, where: Column | None = None) -> DataFrame:
    """Signed rows of one tokenizer version: documents that come (1) or go (-1), with their tokens."""
    rows = counted.filter(where) if where is not None else counted
    return rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("bigint").alias("documents"),
        (F.coalesce(F.col("tokens")[tokenizer], F.lit(0)) * sign).alias("tokens"),
    )


def maintained(
    docs: DataFrame, rollup: Rollup, first: str, revised: str, needs_revision: Column, is_copy: Column
) -> DataFrame:
    """Totals after three batches on ``docs(source, lang, tokens, ...)`` as ``count_tokens`` gives it.

    ``load`` inserts all rows under the tokenizer ``first``; ``revise`` takes those that need it out again and counts
    them under ``revised``; ``takedown`` deletes the rows that are copies from where they are then. Each is
    committed twice, as a retry would.
    """
    keep = ~needs_revision
    batches = {
        "load": [change(docs, first, 1)],
        "revise": [change(docs, first, -1, needs_revision), change(docs, revised, 1, needs_revision)],
        "takedown": [change(docs, first, -1, is_copy & keep), change(docs, revised, -1, is_copy & needs_revision)],
    }
    for _ in range(2):
        for name, parts in batches.items():
            rollup.commit(name, reduce(DataFrame.union, parts))
    return rollup.totals()
