"""Tables written to the shared folder, so that lineage ends there and lost executors cost only their own tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; the warehouse folder, which executors share too, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_written"
    return folder.rstrip("/")


_noting: list[list[str]] = []


@contextmanager
def tables_noted() -> Iterator[list[str]]:
    """The paths of all tables written within, for :func:`forget_paths` once nothing reads them any more."""
    paths: list[str] = []
    _noting.append(paths)
    try:
        yield paths
    finally:
        _noting[:] = [x for x in _noting if x is not paths]


def _note(path: str) -> str:
    for paths in _noting:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = _note(f"{shared_folder(spark)}/llm-{name}-{uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same with the rows in buckets of ``key``, as many as there are shuffle partitions: joins on it move only the
    other side. For keys with few rows each, as a bucket is read by one task."""
    spark, mark = df.sparkSession, uuid4().hex
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("path", _note(f"{shared_folder(spark)}/llm-{name}-{mark}"))
    writer.bucketBy(parts, key).saveAsTable(f"llm_{name}_{mark}")
    return spark.table(f"llm_{name}_{mark}")


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` or :func:`in_buckets` that no later result reads."""
    for df in tables:
        forget_paths(df.sparkSession, [file.rsplit("/", 1)[0] for file in df.inputFiles()[:1]])


def forget_paths(spark: SparkSession, paths: list[str]) -> None:
    """The same by path; paths that are no tables of this module stay, those already gone do no harm."""
    for each in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        if path.getName().startswith("llm-"):
            # tables in buckets have a name besides
            spark.sql(f"DROP TABLE IF EXISTS `{path.getName().replace('-', '_')}`")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000, size: str = "4m") -> DataFrame:
    """``df``; rows go to Python in batches of about ``size`` and at most ``rows`` from here on: texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    return sys.modules.setdefault("_casebook_process_cache", types.ModuleType("_casebook_process_cache")).__dict__
