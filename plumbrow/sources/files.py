"""Table files: CSV as text columns, several CSV files as one table, parquet and other formats, stage tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Doubled quotes inside a quoted field, as CSV writers emit them.
_CSV = {"header": True, "inferSchema": False, "mode": "FAILFAST", "quote": '"', "escape": '"'}

SMALL = 1 << 20  # bytes: headers of smaller files are read together, whole files as they are
POINTER = "_current"  # the file that names the version of a stage to be read


def clean_name(name: str) -> str:
    """A CSV header as a column name: trimmed, blanks to underscores, lower case."""
    return name.strip().replace(" ", "_").lower()


def read_raw_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """CSV with a header line, every column as text. A row of the wrong width fails the read.

    ``multiline`` allows line breaks inside quoted fields; such files cannot be split among tasks.
    """
    df = spark.read.options(**_CSV, multiLine=multiline).csv(path)
    return df.toDF(*[clean_name(c) for c in df.columns])


class CsvFiles(NamedTuple):
    """``rows`` of the files that fit together, and ``left_out(path, columns)``: those that do not."""

    rows: DataFrame
    left_out: DataFrame


def _headers(spark: SparkSession, paths: Sequence[str], multiline: bool) -> list[tuple[str, ...]]:
    """The columns of each of ``paths``, as the CSV reader names them.

    One job reads all files of up to SMALL bytes and sends a hash of each header, so the reader parses one file for each
    header that there is. Larger files and folders are asked one by one, some at a time; each such job reads one line.
    """
    named = [_file_system(spark, p) for p in paths]
    named = [fs.makeQualified(path).toString() for path, fs in named]
    # With ``multiline`` a header ends at the first line break outside quotes; lines of blanks before it are not the header.
    header = r'^\s*(?:[^"\r\n]|"[^"]*")*' if multiline else r"^\s*[^\r\n]*"
    small = spark.read.format("binaryFile").load(list(paths)).filter(F.col("length") <= SMALL)
    line = F.regexp_extract(F.col("content").cast("string"), header, 0)
    hashes = {r[0]: r[1] for r in small.select("path", F.sha2(line, 256)).collect()}
    groups = [hashes.get(n, p) for n, p in zip(named, paths)]
    reader = spark.read.options(**_CSV, multiLine=multiline)
    columns = inheritable_thread_target(spark)(lambda path: tuple(reader.csv(path).columns))
    examples = dict(zip(groups, paths))
    with ThreadPoolExecutor(8) as pool:
        found = dict(zip(examples, pool.map(columns, examples.values())))
    return [found[g] for g in groups]


def read_csv_files(spark: SparkSession, paths: Sequence[str], multiline: bool = False) -> CsvFiles:
    """All rows of several CSV files with header lines. The first file names the columns; a file with another number
    of columns is not read but listed with its number. Large files are split among tasks.

    Files of one header are read in one scan; those whose header only has the first one's width, by position.
    """
    if not paths:
        raise ValueError("no files")
    headers = _headers(spark, paths, multiline)
    width = len(headers[0])
    alike: dict[tuple[str, ...], list[str]] = {}
    for path, columns in zip(paths, headers):
        if len(columns) == width:
            alike.setdefault(columns, []).append(path)
    reader = spark.read.options(**_CSV, multiLine=multiline)
    names = [c.strip() for c in headers[0]]
    schema = StructType([StructField(n, StringType()) for n in headers[0]])  # so that no header is read again
    parts = [reader.schema(schema).csv(same).toDF(*names) for same in alike.values()]
    left = [(p, len(c)) for p, c in zip(paths, headers) if len(c) != width]
    return CsvFiles(reduce(DataFrame.unionByName, parts), spark.createDataFrame(left, "path string, columns int"))


def read_tables(
    spark: SparkSession, folder: str, names: Iterable[str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """One DataFrame per table file ``<folder>/<name>.<fmt>``; nothing is read yet."""
    return {n: spark.read.format(fmt).load(f"{folder.rstrip('/')}/{n}.{fmt}") for n in names}


def _file_system(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder below ``path`` that a stage's pointer names; None if nothing was committed."""
    pointer, fs = _file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name ``version``: a new file takes the old one's place in one step."""
    made, fs = _file_system(spark, f"{path}/{POINTER}-{version}")
    pointer = _file_system(spark, f"{path}/{POINTER}")[0]
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(overwrite, 1)
    options[0] = overwrite.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(made), fs.makeQualified(pointer), options)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The stage that was last committed at ``path``."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no stage was written to {path}")
    return spark.read.format(fmt).load(f"{path.rstrip('/')}/{version}")


def materialize(df: DataFrame, path: str, view: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Write a pipeline stage, replacing what was there, and return the written table.

    Each write is a version, a folder of its own below ``path``; once it is whole, the pointer names it. A write that breaks off
    leaves the stage as it was, and ``df`` may read the stage that it replaces. The version before stays for those who
    still read it; older ones, and what broken writes left, go. ``view`` also registers the table under a name. One writer at a time.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before, version = current_version(spark, path), f"version-{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{path}/{version}")
    _point(spark, path, version)
    folder, fs = _file_system(spark, path)
    for status in fs.listStatus(folder):
        if status.isDirectory() and status.getPath().getName().startswith("version-") and status.getPath().getName() not in (before, version):
            fs.delete(status.getPath(), True)
    out = spark.read.format(fmt).schema(df.schema).load(f"{path}/{version}")
    if view:
        out.createOrReplaceTempView(view)
    return out


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
