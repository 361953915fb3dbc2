"""What the operators share: the columns they read, and the two ways they meet the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.sources.shared import cut  # noqa: F401  (re-exported for the operators)

Batches = Iterator[pa.RecordBatch]

BATCH_BYTES = 4 << 20  # of the rows that go to Python together
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_recorders: list[list[Broadcast]] = []


def share(spark: SparkSession, value: object) -> Broadcast:
    """``value``, plain and of bounded size, for all tasks."""
    made = spark.sparkContext.broadcast(value)
    for known in _recorders:
        known.append(made)
    return made


@contextmanager
def recorded() -> Iterator[list[Broadcast]]:
    """What was shared inside the block; whoever writes the results may destroy it afterwards."""
    made: list[Broadcast] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, an empty one for a null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_of(column: str = "text") -> Column:
    return text_of(column).cast("binary")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def in_parts(batches: Batches, column: int = 1, most: int = 2 << 20) -> Batches:
    """The batches cut into parts of about ``most`` bytes of text in ``column``; a longer text is a part alone.

    Work on a part holds what its bytes need, however many rows Spark puts into a batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, end - first)
            first = end


def batches_of(df: DataFrame, f: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``f`` over the Arrow batches of each partition; nothing is gathered.

    Batches of more than BATCH_BYTES would take memory on both sides, so a larger limit of the session is lowered."""
    conf = df.sparkSession.conf
    limit = conf.get(_BATCH_SETTING).rstrip("b")
    if not limit.isdigit() or int(limit) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def bounded_sample(rows: DataFrame, label: str, doc_id: str, most: int) -> tuple[dict, DataFrame]:
    """The number of rows of each label, and about ``most`` rows of each at most, picked by a hash of the id;
    all rows of a smaller label.

    The counts are over all rows; one number for each label comes to the driver. Nothing else is shuffled.
    ``share`` is the part of its label's rows that a row stands for.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    shares = [x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, most / n)))]
    share = F.create_map(*shares)[F.col(label)] if shares else F.lit(1.0)
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return counts, rows.withColumn("share", share).filter(place < F.col("share"))
