"""Scratch tables, sizes and byte-level helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, as a ``bytes.translate`` table.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary folder only where the session names none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="burrow-"))
    return _LOCAL[0]


def stored(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and lets a lost executor's work be read again."""
    path = f"{scratch_root(df.sparkSession)}/burrow/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._burrow_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_burrow_path", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; used to choose numbers of partitions only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 30


def lower(column) -> F.Column:
    """Lower-case A-Z alone."""
    return F.translate(column, UPPER_LETTERS, LOWER_LETTERS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
