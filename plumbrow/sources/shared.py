"""Folder shared by all executors, for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """Where intermediate tables of this application go: below ``folder``, else below the folder that
    the session names in ``spark.checkpoint.dir``, else below the warehouse."""
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/plumbrow-{spark.sparkContext.applicationId}"


_recorders: list[list[str]] = []


def new_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    path = f"{shared_dir(spark, folder)}/{label}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are given out inside the block."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def cut(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Iterative jobs call this once per round, so plans stay short, a lost executor never replays
    earlier rounds, and the next join is planned with the real size of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the intermediate tables of this application; call it once results are written."""
    drop(spark, [shared_dir(spark, folder)])


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
