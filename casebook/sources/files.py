"""Readers and writers for CSV, delimited text and parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIPE = "|"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan. Without a schema Spark infers one, which costs a full extra scan."""
    return read_delimited(spark, path, sep=",", schema=schema, header=header, infer=schema is None)


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = PIPE,
                   schema: StructType | str | None = None, header: bool = True, infer: bool = False) -> DataFrame:
    """Delimited scan; without a schema every column is a string."""
    reader = spark.read.option("sep", sep).option("header", header)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return reader.csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, n_files: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path``. ``n_files`` costs a shuffle; leave it out to keep the plan's own partitioning."""
    df = df if n_files is None else df.repartition(n_files)
    df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)


def write_csv(df: DataFrame, path: str, header: bool = True, n_files: int | None = None, sep: str = ",") -> None:
    """Overwrite ``path`` with delimited text; ``n_files`` as in :func:`write_parquet`."""
    df = df if n_files is None else df.repartition(n_files)
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def read_fold_scores(spark: SparkSession, paths: list[str], schema: StructType | str,
                     fold_pattern: str = r"fold[_=](\d+)") -> DataFrame:
    """Stack per-fold score files; the fold number comes from each file's own path."""
    scores = read_csv(spark, paths, schema)
    # the last part of the path that starts with a fold or has one after a mark (scores_fold_2.csv, not manifold_2); a
    # path without one fails the cast below
    fold = F.regexp_extract(F.input_file_name(), rf"^.*(?:/|/[^/]*[_.=-]){fold_pattern}(?![A-Za-z0-9])(?:[^/]*)(?:/.*)?$", 1)
    return scores.withColumn("fold", fold.cast("int"))
