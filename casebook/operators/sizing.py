"""Size checks that choose a join, and joins that split hot keys.

A join on a key that holds a third of all rows would put a third of the data in one task. ``lookup_join`` and
``pair_join`` find such keys with one sketch over the key columns, then spread only their rows over salts.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import cache, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows (so there are fewer than 2 / HOT_SHARE candidates), and
# more rows than any task takes with ease.
HOT_SHARE = 1 / 4000
HOT_ROWS = 100_000
# A table is broadcast only when it is known to stay below both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024
# Rows of a bucket, which one task sorts.
BUCKET_ROWS = 500_000


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(df: DataFrame, rows: int) -> int:
    """Buckets for a table of ``rows`` rows like ``df``: a multiple of the shuffle partitions, so that a task that has one of
    these writes to few buckets, with at most ``BUCKET_ROWS`` rows in each on average."""
    partitions = shuffle_partitions(df)
    return partitions * max(1, math.ceil(rows / (partitions * BUCKET_ROWS)))


@contextmanager
def configured(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for what is run within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sorted_aggregates(spark: SparkSession):
    """Aggregates that collect sets read sorted rows in order, for what is run within.

    Spark's other way for them gives up its hash table after 128 keys and sorts all rows once more.
    """
    return configured(spark, "spark.sql.execution.useObjectHashAggregateExec", "false")


def compilable_methods(spark: SparkSession):
    """No generated method beyond the 8000 bytes that the JVM compiles, for what is run within.

    One method for all columns of a wide table would run interpreted; split by column, its parts are compiled.
    """
    return configured(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def _shuffles_dropped(spark: SparkSession):
    """What is written within leaves no shuffle files; otherwise they stay until the JVM happens to collect its garbage."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, in the folder the cluster names for checkpoints, and read it back.

    Unlike a checkpoint the parquet table lets each reader scan its own columns only.
    """
    path = _note(f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}")
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_noting: list[list[str]] = []


@contextmanager
def tables_noted() -> Iterator[list[str]]:
    """The paths of all tables written within, for :func:`forget` once nothing reads them any more."""
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


def forget(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete tables by the paths of :func:`tables_noted`; those already gone do no harm."""
    for each in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        if path.getName().startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {path.getName()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode with none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="casebook-")


def hot_hashes(df: DataFrame, on: str | Sequence[str], share: float | None = None,
               rows: int | None = None) -> dict[int, int]:
    """Hashes of the keys that hold more than ``share`` of the rows and more than ``rows`` rows, and for each the number
    of salts that brings its rows down to half an average shuffle partition.

    One pass over the key columns. Each of up to 64 groups of input partitions keeps a bounded frequent-items
    sketch, the sketches are added up, and a bounded list reaches the driver. A key that is listed without being hot
    costs nothing but its salts, so results never depend on the sketch.
    """
    share, rows = share or HOT_SHARE, HOT_ROWS if rows is None else rows
    keep = math.ceil(2 / share)
    sketches = (
        df.select(_key_hash(df, as_list(on)).alias("h"), (F.spark_partition_id() % 64).alias("part"))
        .groupBy("part")
        .agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {keep}, {8 * keep})").alias("top"))
        .select("n", F.filter("top", lambda t: t["count"] > rows / 128).alias("top"))
        .collect()
    )
    total = sum(sketch["n"] for sketch in sketches)
    seen: dict[int, int] = {}
    for sketch in sketches:
        for item, count in sketch["top"]:
            seen[item] = seen.get(item, 0) + count
    partitions = shuffle_partitions(df)

    def salts(count: int) -> int:
        # powers of two keep the number of different salt counts small
        wanted = 1 << math.ceil(math.log2(max(2, 2 * partitions * count / total)))
        return max(2, min(wanted, partitions))

    return {h: salts(count) for h, count in sorted(seen.items()) if count > max(total * share, rows) / 2}


def _key_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """One hash for equal whole numbers of any width, so that a hot list holds for tables that type a key differently."""
    types = dict(df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(on)]).dtypes)
    narrow = ("tinyint", "smallint", "int")
    return F.xxhash64(*[F.col(c).cast("long") if types[f"_{i}"] in narrow else F.col(c) for i, c in enumerate(on)])


def split_hot(df: DataFrame, on: str | Sequence[str], hot: Mapping[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys, and the others. ``on`` may name fields of structs."""
    is_hot = _key_hash(df, as_list(on)).isin(list(hot))
    return df.filter(is_hot), df.filter(~is_hot)


def small_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """For each column, whether a lookup table with a row per value is small enough to broadcast.

    Columns that a sketch puts far above the bound are not small; the values of the others are counted exactly.
    """
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    countable = [c for c in columns if about[c] <= 1.25 * BROADCAST_ROWS]
    small = {c: False for c in columns if c not in countable}
    if countable:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in countable])
        values = texts.unpivot([], countable, "column", "value").filter(F.col("value").isNotNull())
        small |= small_values(values.distinct())
    return small


def small_values(values: DataFrame) -> dict[str, bool]:
    """The same for a table of distinct ``(column, value)`` rows."""
    sizes = values.groupBy("column").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")
    )
    return {
        row["column"]: row["n"] <= BROADCAST_ROWS and (row["bytes"] or 0) <= BROADCAST_BYTES
        for row in sizes.collect()
    }


def lookup_join(rows: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "inner",
                hot: Mapping[int, int] | None = None, small: bool = False, null_safe: bool = False) -> DataFrame:
    """Join many rows to a table with one row per key.

    ``small`` says that the table's size has been checked: it is broadcast and ``rows`` are not shuffled. Otherwise
    both sides are shuffled on the key, and the rows of each hot key spread over its salts. ``hot`` takes the result of
    :func:`hot_hashes`, so that one check can serve several joins; by default the check runs here.
    """
    on = as_list(on)
    if small:
        return _join(rows, F.broadcast(table), on, how, null_safe)
    hot = hot_hashes(rows, on) if hot is None else hot
    if not hot:
        return _join(rows, table, on, how, null_safe)
    names = rows.columns + ([c for c in table.columns if c not in on] if how not in ("left_semi", "left_anti") else [])
    rows, table, keys = _aligned(rows, table, on)
    # keys that had to be cast hash otherwise than those the list was made of
    hot = hot if keys == on else hot_hashes(rows, keys)
    if hot:
        n = _salts(rows, keys, hot)
        rows = rows.withColumn("_salt", _own_salt(rows, n))
        table = table.withColumn("_salt", F.explode(_every_salt(_salts(table, keys, hot))))
        keys = [*keys, "_salt"]
    return _join(rows, table, keys, how, null_safe).select(*[F.col(f"`{c}`") for c in names])


def pair_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join of two tables that may both have many rows for a key.

    A hot key gets a square of salts: a left row takes one line of it, a right row one column, and they meet in the
    field where the two cross.
    """
    on = as_list(on)
    names = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    plain = left, right
    left, right, keys = _aligned(left, right, on)
    both = [hot_hashes(side, keys) for side in (left, right)]
    hot = {h: math.ceil(math.sqrt(max(found.get(h, 1) for found in both))) for h in {**both[0], **both[1]}}
    if not hot:
        return plain[0].join(plain[1], on)
    n, m = _salts(left, keys, hot), _salts(right, keys, hot)
    left = left.withColumn("_line", _own_salt(left, n)).withColumn("_column", F.explode(_every_salt(n)))
    right = right.withColumn("_column", _own_salt(right, m)).withColumn("_line", F.explode(_every_salt(m)))
    return left.join(right, [*keys, "_line", "_column"]).select(*[F.col(f"`{c}`") for c in names])


def _aligned(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the names of their keys. Where types differ, the key is in a column of its own on both sides, in
    the type in which Spark compares the two, so that equal keys hash alike and unequal ones stay so."""
    types, keys = [dict(left.dtypes), dict(right.dtypes)], []
    whole = ("tinyint", "smallint", "int", "bigint")
    for c in on:
        a, b = (t[c] for t in types)
        if a == b or a in whole and b in whole:
            keys.append(c)
            continue
        nulls = left.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("x"))
        common = nulls.schema["x"].dataType
        left, right = (side.withColumn(f"_key_{c}", F.col(c).try_cast(common)) for side in (left, right))
        right = right.drop(c)
        keys.append(f"_key_{c}")
    return left, right, keys


def _salts(df: DataFrame, on: list[str], hot: Mapping[int, int]) -> Column:
    """Number of salts of a row's key: 1 unless it is hot."""
    tiers: dict[int, list[int]] = {}
    for h, n in hot.items():
        tiers.setdefault(n, []).append(h)
    key = _key_hash(df, on)
    cases = [(key.isin(hashes), n) for n, hashes in sorted(tiers.items())]
    return reduce(lambda column, case: column.when(*case), cases[1:], F.when(*cases[0])).otherwise(1)


def _own_salt(df: DataFrame, n: Column) -> Column:
    # The partition id keeps equal copies of one row apart; both inputs of the hash survive a retried task.
    # Maps cannot be hashed; rows that differ in one only share a salt.
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    drawn = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), n)
    return F.when(n > 1, drawn).otherwise(0).cast("int")


def _every_salt(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _join(rows, table, on, how, null_safe):
    if not null_safe:
        return rows.join(table, on, how)
    renamed = table.withColumnsRenamed({c: f"_table_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_table_{c}"]) for c in on])
    joined = rows.join(renamed, condition, how)
    return joined.drop(*[f"_table_{c}" for c in on])


def bucketed(df: DataFrame, key: str, sort: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Write a table in buckets of ``key``, sorted by key and ``sort``, in the folder the cluster names for checkpoints.

    Groupings, windows and joins on the key read it without a shuffle, joins with a table of as many buckets included. A
    bucket is read by one task, so a table with a hot key belongs into :func:`materialise`.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid4().hex}"
    writer = df.write.format("parquet").option("path", _note(f"{shared_folder(spark)}/{name}"))
    with _shuffles_dropped(spark):
        writer.bucketBy(buckets or shuffle_partitions(df), key).sortBy(key, *sort).saveAsTable(name)
    return spark.table(name)
