"""Keys that hold a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casebook.operators import asof, history, rank, sizing
from casebook.operators.eventlog import EventLog


@pytest.fixture
def skewed(spark):
    """30,000 rows: a third belongs to key 0, a third are copies of one row with a null key."""
    n = 10_000
    ids = spark.range(3 * n, numPartitions=6)
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    return ids.select(key.cast("long").alias("k"), F.when(F.col("id") % 3 != 1, F.col("id")).alias("v"))


@pytest.fixture
def names(spark):
    return spark.range(30_000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))


def test_hot_keys_are_found(spark, skewed):
    hot = sizing.hot_hashes(skewed, "k", share=0.1, rows=1000)
    expected = spark.range(1).select(F.xxhash64(F.lit(0).cast("long")), F.xxhash64(F.lit(None).cast("long"))).first()
    assert set(hot) == set(expected) and set(hot.values()) == {4}
    assert sizing.hot_hashes(skewed, "k", share=0.1) == {}  # too few rows to matter
    assert sizing.hot_hashes(skewed.limit(0), "k", rows=0) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(skewed, names, how, null_safe):
    if null_safe and how in ("left_semi", "left_anti"):
        return
    hot = sizing.hot_hashes(skewed, "k", share=0.1, rows=0)
    salted = sizing.lookup_join(skewed, names, "k", how, hot=hot, null_safe=null_safe)
    plain = sizing.lookup_join(skewed, names, "k", how, hot={}, null_safe=null_safe)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == plain.exceptAll(salted).count() == 0
    assert salted.count() == plain.count()


def test_hot_rows_are_spread(skewed, names, spark, partitions):
    partitions(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        hot = sizing.hot_hashes(skewed, "k", share=0.1, rows=0)
        joined = sizing.lookup_join(skewed, names, "k", "left", hot=hot)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 10_000


def test_pairs_of_two_hot_sides_meet_once(spark, everything_hot):
    left = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select((F.col("id") % 4).cast("int").alias("k"), F.col("id").alias("b"))
    pairs = sizing.pair_join(left, right, "k")
    plain = left.join(right, "k")
    assert pairs.count() == plain.count() == pairs.distinct().count()


KEYS = {"int": [1, 1, 1, 2, None, 3], "bigint": [1, 2, 2, 4, None], "double": [1.0, 1.5, 2.0, None, 3.0],
        "decimal(6,2)": ["1.00", "1.50", "2.00", None, "2.50"], "string": ["1", "01", "2", None, "3"], "smallint": [1, 3, None]}


def _keyed(spark, kind, name):
    values = [(None if v is None else str(v), i) for i, v in enumerate(KEYS[kind] * 3)]
    return spark.createDataFrame(values, f"k string, {name} int").withColumn("k", F.col("k").cast(kind))


@pytest.mark.parametrize("left, right", [("int", "double"), ("double", "bigint"), ("string", "int"), ("double", "string"),
                                         ("int", "decimal(6,2)"), ("decimal(6,2)", "double"), ("smallint", "bigint")])
def test_salted_joins_of_unlike_keys_equal_plain_ones(spark, left, right, everything_hot):
    rows, table = _keyed(spark, left, "a"), _keyed(spark, right, "b").dropDuplicates(["k"])
    for how in ("left", "left_anti"):
        salted, plain = sizing.lookup_join(rows, table, "k", how), rows.join(table, "k", how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect())), how
    many = _keyed(spark, right, "b")
    assert sorted(map(str, sizing.pair_join(rows, many, "k").collect())) == sorted(map(str, rows.join(many, "k").collect()))


def test_a_hot_list_holds_for_whole_numbers_of_any_width(spark):
    narrow = spark.range(100).select((F.col("id") % 2).cast("int").alias("k"))
    found = [set(sizing.hot_hashes(df, "k", share=0.1, rows=10)) for df in (narrow, narrow.select(F.col("k").cast("long")))]
    assert found[0] == found[1] and len(found[0]) == 2


def test_small_columns(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").alias("many"), (F.col("id") % 3).alias("few"), F.lit(None).alias("none"))
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 10)
    assert sizing.small_columns(df, ["many", "few", "none"]) == {"many": False, "few": True}


def test_shared_folder_is_the_clusters(spark):
    assert sizing.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    written = sizing.materialise(spark.range(3))
    assert written.count() == 3 and spark.conf.get("spark.checkpoint.dir") in written.inputFiles()[0]


def test_ranges_are_even_whatever_the_keys(spark, partitions):
    partitions(16)
    keys = spark.range(200_000).select(F.when(F.col("id") < 190_000, F.col("id") / 1e6).otherwise(F.exp(F.col("id") / 2e4)).alias("k"))
    ranged = rank.range_buckets(keys.distinct(), ["k"])
    rows = ranged.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    rows = rows.orderBy("_bucket").collect()
    assert len(rows) == 64 and sum(r["n"] for r in rows) == 200_000
    assert max(r["n"] for r in rows) < 2 * 200_000 / len(rows)
    assert all(a["high"] < b["low"] for a, b in zip(rows, rows[1:]))


def test_ranks_go_on_past_any_number_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANGES_PER_PARTITION", 100)  # more ranges than keys, some of them empty
    ranked = rank.rank_table(spark.range(300).select((F.col("id") * 7 % 300).alias("k")), "k").collect()
    assert sorted((r["k"], r["before"], r["total"]) for r in ranked) == [(i, i, 300) for i in range(300)]


def _log_with_a_hot_case(spark):
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 0).otherwise(F.col("id") % 40).cast("int").alias("case"),
        (F.col("id") * 7919 % 1000).alias("at"), (F.col("id") % 5).cast("string").alias("kind"))
    return events, EventLog("case", "at"), sizing.hot_hashes(events, "case", share=0.1, rows=10)


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("what", ["gap", "counts", "prior", "latest", "latest of a wider key"])
def test_only_hot_cases_go_in_ranges(spark, monkeypatch, what):
    events, log, hot = _log_with_a_hot_case(spark)
    assert len(hot) == 2
    seen = []
    plain_ranges = rank.range_buckets
    for module in (history, asof):
        monkeypatch.setattr(module, "range_buckets", lambda df, keys: seen.append(plain_ranges(df, keys)) or seen[-1])

    def run(hot):
        if what == "gap":
            return history.gap_to_previous(events, log, hot)
        if what == "counts":
            return history.pivot_counts(events, log, "kind", ["0", "1"], hot)
        if what == "prior":
            return history.prior_counts(events, log, "kind", hot=hot)
        left = events.select(F.col("case").cast("double" if "wider" in what else "int"), F.col("at").alias("at"), "kind")
        right = events.filter("at % 7 = 0").select("case", "at", F.concat("kind", F.lit("!")).alias("said"))
        return asof.latest_before(left, right, "case", "at", ["said"], hot=hot)

    _same(run(hot), run({}))
    cases = {r[0] for df in seen for r in df.select(
        "_line._case.case" if "_line" in df.columns else "case").distinct().collect()}
    assert len(seen) == 1 and cases <= {0, None} and 0 in cases
