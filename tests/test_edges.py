"""Hand-made tables: ties, nulls, single rows, unmatched rows."""

from __future__ import annotations

import math
import os
import time

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casebook.functions import geography
from casebook.functions.text import leading_digit, word_count
from casebook.operators import (asof, assemble, clean, encode, evaluate, features, folds, geo, history, labels, profile,
                                rank, sizing)
from casebook.operators.eventlog import EventLog
from casebook.plans import model_table, training
from casebook.plans.trees import Trees
from casebook.sources import files

LOG = EventLog(key="id", time="t", ties=("tie",))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# ---- cleaning

def test_rename_refuses_two_columns_with_one_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert clean.rename_columns(df, {"a": "x"}).columns == ["x", "b", "c"]
    assert clean.rename_columns(df, {"a": "b", "b": "a"}).columns == ["b", "a", "c"]
    with pytest.raises(ValueError):
        clean.rename_columns(df, {"a": "C"})


def test_bad_numbers_and_zero(spark):
    df = spark.createDataFrame([("12 7", 0), ("7", 4), (None, None)], "note string, s int")
    out = df.select(clean.null_if("note", 7).alias("n"), encode.sentinel_flag("note", 7).alias("f"),
                    clean.reciprocal("s").alias("r"), clean.flag("s").alias("has"), word_count("note").alias("w"),
                    leading_digit("note").alias("d"))
    assert [tuple(r) for r in out.collect()] == [
        ("12 7", 0, None, 1, 2, 1), (None, 1, 0.25, 1, 1, 7), (None, 0, None, 0, None, None)]


def test_parse_flag_and_cast(spark):
    df = spark.createDataFrame([("true", "1"), ("false", "x"), ("?", None)], "f string, n string")
    out = clean.cast_columns(df.withColumn("f", clean.parse_flag("f")), {"n": "int"})
    assert [tuple(r) for r in out.collect()] == [(1, 1), (0, None), (None, None)]


def test_fill_null_checks_types(spark):
    df = spark.createDataFrame([(None, None)], "cloud string, n int")
    assert clean.fill_null(df, {"n": 0, "cloud": "0"}).first() == ("0", 0)
    with pytest.raises(TypeError):
        clean.fill_null(df, {"cloud": 0})


def test_union_of_tables_with_different_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, z int")
    assert rows(clean.union_all([a, b]), "y") == [(1, 2, None), (None, 3, 4)]


# ---- profiles

def test_profiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    summary = profile.null_summary(df)
    assert rows(summary) == [(0, "a", 0, None), (0, "b", 0, None)]
    assert profile.key_check(df, ["a"]).first() == (0, 0, 0)


def test_unique_summary_defaults_to_all_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, None)], "a int, b string")
    out = profile.unique_summary(df, include_percent=True)
    assert {r["column"]: r["unique_count"] for r in out.collect()} == {
        "count_unique_a": 2.0, "count_unique_b": 1.0, "percent_unique_a": 2 / 3, "percent_unique_b": 0.5}
    approximate = profile.unique_summary(df, approx=True)
    assert {r["unique_count"] for r in approximate.collect()} == {2.0, 1.0}


# ---- ranks and encoders

def test_one_row_has_percent_rank_0(spark):
    df = spark.createDataFrame([(5,)], "v int")
    assert rank.global_rank(df, "v").first() == (5, 1, 1.0, 0.0)


def test_rank_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None,), (3,), (3,), (1,)], "v int")
    assert rows(rank.global_rank(df, "v").select("v", "rank", "average_rank"), F.asc_nulls_first("v")) == [
        (None, 1, 1.0), (1, 2, 2.0), (3, 3, 3.5), (3, 3, 3.5)]


def test_rank_table_of_a_plain_table(spark, folder):
    """Ranks straight from a scan: the optimizer sees through the range numbers here."""
    line = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_extendedprice")
    ranked = rank.rank_table(line, "l_extendedprice").orderBy("l_extendedprice").collect()
    expected = 0
    for row in ranked:
        assert row["before"] == expected
        expected += row["cnt"]
    assert expected == line.count() == ranked[0]["total"]
    whole = rank.rank_table(line.withColumn("n", F.lit(1)), ["l_orderkey", "l_extendedprice"], n="n")
    assert {r["total_n"] for r in whole.collect()} == {expected}


def test_labels_with_equal_counts_and_a_large_null_group(spark):
    df = spark.createDataFrame([(c,) for c in (None, None, None, "b", "a", "c", "c")], "c string")
    assert rows(encode.label_table(df, "c")) == [("a", 2), ("b", 3), ("c", 1)]
    coded = encode.label_encode(df, "c")
    assert coded.count() == 7 and coded.filter("c IS NULL AND label_encoded_c IS NULL").count() == 3


def test_out_of_fold_means_leave_the_own_fold_out(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 0, 1)], "c string, f int, y int")
    out = rows(encode.target_encode(df, "c", "y", "f").select("c", "f", "y", "mean_response_rate_c"))
    assert out == [("a", 0, 1, 0.5), ("a", 1, 0, 1.0), ("a", 1, 1, 1.0), ("b", 0, 1, None)]


def test_many_encodings_equal_the_single_ones(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 0), (4, None, 1)], "id int, c string, y int")
    many = encode.encode_packed(df, "id", "y", {"c": "c"}, {"c": "c"}, {"c": "c"})
    assert rows(many, "id") == [
        (1, "a", 1, 1, 0.5, 1), (2, "a", 0, 1, 0.5, 1), (3, "b", 0, 2, 0.0, 0), (4, None, 1, None, None, 0)]


def test_many_encodings_out_of_fold_do_not_see_the_own_fold(spark):
    df = spark.createDataFrame([(1, "a", 7, 1, 0), (2, "a", 7, 0, 1), (3, "a", 8, 0, 0), (4, "b", 8, 1, 0), (5, "b", 7, None, None),
                                (6, "c", 9, None, None)], "id int, c string, d int, y int, f int")
    many = encode.encode_packed(df, "id", "y", {"c": "c", "d": "d"}, {"c": "c", "d": "d"}, {"c": "c"}, "f")
    found = {r["id"]: r for r in many.collect()}
    assert [found[i]["mean_response_rate_c"] for i in range(1, 7)] == [0.0, 0.5, 0.0, None, 1.0, None]
    assert [found[i]["is_in_escalated_c"] for i in range(1, 7)] == [0, 1, 0, 0, 1, 0]
    assert [found[i]["label_encoded_c"] for i in range(1, 7)] == [1, 1, 1, 2, 2, 3]
    assert [found[i]["label_encoded_d"] for i in range(1, 7)] == [1, 1, 2, 2, 1, 3]
    assert found[1]["mean_response_rate_d"] == 0.0 and found[5]["mean_response_rate_d"] == 0.5


def test_packed_encodings_add_up_folds_per_value_not_per_row(spark):
    df = sizing.materialise(spark.createDataFrame(
        [(1, "a", 1.0, 0), (2, "a", 3.0, 1), (3, "a", None, 1), (4, "a", 5.0, None), (5, "b", 0.0, 0), (6, None, 2.0, 1)],
        "id long, c string, y double, f int"))
    got = encode.encode_packed(df, "id", "y", {"c": "c"}, {"c": "c"}, {"c": "c"}, "f")
    assert rows(got.select("id", "label_encoded_c", "mean_response_rate_c", "is_in_escalated_c")) == [
        (1, 1, 4.0, 1), (2, 1, 3.0, 1), (3, 1, 3.0, 1), (4, 1, 3.0, 1), (5, 2, None, 0), (6, None, None, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert not any("lambda" in line for line in plan[:joins[1]]) and any("lambda" in line for line in plan)


# ---- history

def events(spark, data):
    return spark.createDataFrame(data, "id long, t long, tie int, v string")


def test_last_value_uses_ties_and_keeps_null(spark):
    df = events(spark, [(1, 5, 2, "late"), (1, 5, 1, "early"), (2, 1, 0, "x"), (2, 2, 0, None)])
    out = df.groupBy("id").agg(history.last_value(LOG, "v"), history.first_value(LOG, "v"))
    assert rows(out, "id") == [(1, "late", "early"), (2, None, "x")]
    assert rows(history.latest_row(df, LOG).select("id", "v")) == [(1, "late"), (2, None)]
    assert rows(history.nth_last(df, LOG, 2).select("id", "v")) == [(1, "early"), (2, "x")]


def test_gaps_of_ties_and_single_events(spark):
    day = 86400
    df = events(spark, [(1, 0, 0, ""), (1, 2 * day, 0, ""), (1, 2 * day, 1, ""), (2, 7, 0, "")])
    assert rows(history.last_gap(df, LOG)) == [(1, 0.0), (2, None)]
    assert rows(df.groupBy("id").agg(history.mean_gap(LOG)), "id") == [(1, 1.0), (2, None)]
    expected = [(1, 0, 1, None), (1, 2 * day, 2, 2 * day), (2, 7, 1, None)]
    assert rows(history.gap_to_previous(df, LOG, hot={})) == expected
    assert rows(history.gap_to_previous(df, LOG, hot={1: 2})) == expected


def test_prior_counts_count_strictly_earlier_events(spark):
    df = events(spark, [(1, 0, 0, "a"), (1, 5, 0, "a"), (1, 5, 1, "b"), (1, 9, 0, "b")])
    for hot in ({}, {1: 2}):
        wide = history.pivot_counts(df, LOG, "v", ["a", "b"], hot)
        assert rows(wide.select("t", "total", "count_a", "first_time_a", "last_time_a", "count_b"), "t") == [
            (0, 0, 0, None, None, 0), (5, 1, 1, 0, 0, 0), (9, 3, 2, 0, 5, 1)]
        assert rows(history.prior_counts(df, LOG, "v", hot=hot).select("t", "v", "prior_count")) == [
            (5, "a", 1), (9, "a", 2), (9, "b", 1)]


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (1, 9), (2, 3)], "id long, t long")
    right = spark.createDataFrame([(1, 5, "x", 1), (1, 5, "y", 2), (1, 6, None, 3)], "id long, t long, v string, n int")
    for hot in ({}, {1: 2}):
        found = asof.latest_before(left, right, "id", "t", ["v", "n"], ties=["n"], hot=hot)
        assert rows(found) == [(1, 0, None, None), (1, 5, "y", 2), (1, 5, "y", 2), (1, 9, None, 3), (2, 3, None, None)]
        strict = asof.latest_before(left, right, "id", "t", ["v", "n"], ties=["n"], strict=True, hot=hot)
        assert rows(strict) == [(1, 0, None, None), (1, 5, None, None), (1, 5, None, None), (1, 9, None, 3),
                                (2, 3, None, None)]


def test_counts_as_of_response_rows(spark):
    df = events(spark, [(1, 2, 0, "a"), (1, 5, 0, "b")])
    asked = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 0)], "id long, t long")
    for hot in ({}, {1: 2}):
        counts = history.pivot_counts(df, LOG, "v", ["a", "b"], hot)
        found = history.as_of_rows(asked, counts, LOG, hot).select(
            "id", "t", "total", "count_a", "first_time_a", "first_time_b", "seconds_to_closest_milestone_features")
        assert rows(found) == [(1, 1, None, None, None, None, None), (1, 5, 1, 1, 2, -999, 0),
                               (1, 9, 1, 1, 2, -999, 4), (2, 0, None, None, None, None, None)]


# ---- labels

def test_positive_targets_do_not_look_ahead(spark):
    df = spark.createDataFrame(
        [(1, 0, "N", 0.2), (1, 4, "N", 0.5), (1, 6, "Y", None), (1, 8, "N", 0.9), (2, 0, "Y", None)],
        "id long, t long, e string, r double")
    windows = labels.event_window(df, LOG, F.col("e") == "Y")
    assert rows(windows) == [(1, 6, 6), (2, 0, 0)]
    # case 2 starts escalated and drops out
    assert rows(labels.positive_targets(df, windows, LOG, "r")) == [(1, 4, 0.5)]


def test_rows_at_the_cut_are_not_used(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (2, 0)], "id long, t long")
    cuts = spark.createDataFrame([(1, 5.0), (2, 0.0)], "id long, time_cut double")
    assert rows(labels.negative_targets(df, cuts, LOG)) == [(1, 0, 0.0)]
    assert labels.audit_dropped(df, cuts, LOG).first().asDict() == {
        "negative_cases": 2, "with_decision": 1, "rows_at_cut": 2, "lost_cases": 1}
    assert asof.cut_at(df, cuts, LOG, "time_cut").count() == 3


def test_no_positive_case_gives_no_cuts(spark):
    df = spark.createDataFrame([(1, 0, "N")], "id long, t long, e string")
    windows = labels.event_window(df, LOG, F.col("e") == "Y")
    points = labels.relative_point_distribution(windows)
    assert labels.negative_cuts(df, windows, points, LOG).count() == 0


def test_folds_are_grouped_and_all_used(spark):
    out = folds.assign(spark.range(2000).selectExpr("id % 500 AS id"), "id").distinct()
    assert out.count() == 500
    assert {r[0] for r in out.select("cross_validation_fold_0").distinct().collect()} == set(range(5))


# ---- features

def test_missing_and_dummy_notes(spark):
    data = [(1, 0, 0, 7, "one two", "6763", 3), (1, 86400, 0, 8, "one", None, 4), (2, 0, 0, 7, None, "a b c", None)]
    df = spark.createDataFrame(
        data, "id long, t long, tie int, milestone_id int, milestone_description string, note_description string,"
              "updated_by int")
    positives = spark.createDataFrame([(1,)], "id long")
    out = {r["id"]: r for r in features.milestones(df, positives, LOG).collect()}
    assert out[1]["last_length_of_note_description_null_for_6763"] == -999
    assert out[1]["proportion_is_milestone_note_6763"] == 0.5
    assert out[1]["average_length_of_note_description_null_for_6763"] is None
    assert out[1]["average_length_of_milestone_descriptions"] == 1.5
    assert out[1]["cutoff_seconds_since_previous_milestone"] == 1.0
    assert out[1]["mean_response_rate_last_milestone_id"] == 1.0
    assert out[2]["last_length_of_note_description_null_for_6763"] == 3
    assert out[2]["length_of_last_milestone_description"] is None
    assert out[2]["last_label_encoded_updated_by"] is None


def test_severity_change_compares_both_ends(spark):
    df = spark.createDataFrame([(1, 0, 0, "3 - high"), (1, 9, 0, "1 - low"), (2, 0, 0, "odd")],
                               "id long, t long, tie int, severity string")
    out = {r["id"]: r for r in features.status_history(df, spark.createDataFrame([(1,)], "id long"), LOG).collect()}
    assert out[1]["case_severity_has_changed_between_start_and_end"] == 1
    assert out[2]["case_severity_has_changed_between_start_and_end"] == 0
    assert out[2]["initial_case_severity_level"] is None


def test_text_terms(spark):
    df = spark.createDataFrame([(1, 0, "a b a"), (1, 1, "b c"), (2, 0, None)], "id long, t long, x string")
    assert rows(features.text_terms(df, EventLog("id", "t"), "x")) == [(1, 2.0, 2, 3), (2, None, None, 0)]


def test_model_table_keeps_cases_without_features(spark):
    response = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.0)], "id long, response double")
    some = spark.createDataFrame([(1, 7)], "id long, a int")
    attributes = spark.createDataFrame([(1, 1), (2, 2)], "id long, b int")
    table = assemble.model_table(response, [some], [attributes], "id")
    assert rows(table.select("id", "a", "b", "in_train")) == [(1, 7, 1, 1), (2, None, 2, 0)]
    train, score = assemble.split_train_score(table)
    assert train.count() == score.count() == 1
    assert training.feature_columns(table, "id", "response") == ["a", "b"]


def test_rates_see_no_label_of_a_case_to_score(spark):
    cut = spark.createDataFrame([(i, 0, "1 low" if i % 3 else "2 high") for i in range(12)], "id long, t long, severity string")
    training = spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, cross_validation_fold_0 int")
    log = EventLog("id", "t")
    few, more = ([(i,) for i in x] for x in ((1, 2, 3), (1, 2, 3, 9, 10)))
    one, two = (rows(features.status_history(cut, spark.createDataFrame(x, "id long"), log, training=training))
                for x in (few, more))
    assert one == two
    rate = {r["id"]: r["mean_response_rate_initial_case_severity_level"] for r in features.status_history(
        cut, spark.createDataFrame(few, "id long"), log, training=training).collect()}
    # level 1 in training: 1, 2, 4, 5, 7; of these 1 and 2 are positive
    assert rate[10] == 2 / 5 and rate[1] == 1 / 2 and rate[2] == 1 / 3


def test_models_see_decimals_and_booleans(spark):
    table = spark.createDataFrame([(1, 0.5, True, "x")], "id long, response double, flag boolean, s string")
    table = table.selectExpr("*", "CAST(1.5 AS DECIMAL(8, 2)) AS price", "1 AS n")
    assert training.feature_columns(table, "id", "response") == ["flag", "price", "n"]
    numbers = training._numbers(table, ["flag", "price"]).select("flag", "price")
    assert rows(numbers) == [(1.0, 1.5)]


# ---- evaluation

def scored(spark, data):
    return spark.createDataFrame([(float(p), float(o)) for p, o in data], "predicted double, observed double")


def test_all_scores_equal(spark):
    df = scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)])
    assert evaluate.auc(df).first()[0] == 0.5
    assert evaluate.pvo(df).count() == 1
    assert evaluate.gains(df).first()["gains"] == 1.0


def test_perfect_scores(spark):
    df = scored(spark, [(1, 1), (0, 0), (1, 1), (0, 0)])
    assert evaluate.gini(df).first()["normalised_gini"] == 1.0
    assert evaluate.auc(df).first()[0] == 1.0
    assert evaluate.log_loss(df).first()[0] == pytest.approx(-math.log(1 - 1e-15))
    assert evaluate.precision_recall(df).first() == (1.0, 1.0)


def test_one_class_or_one_row(spark):
    df = scored(spark, [(0.4, 0)])
    assert evaluate.auc(df).first()[0] is None
    assert evaluate.precision_recall(df).first() == (0.0, 0.0)
    assert evaluate.regression_metrics(df).first()["r2"] is None


def test_gini_against_a_direct_sum(spark):
    data = [(0.9, 1), (0.9, 0), (0.3, 1), (0.2, 0), (0.2, 0), (0.1, 1)]
    ordered = sorted(data, key=lambda x: (-x[0], x[1]))
    total, cumulative, summed = sum(o for _, o in data), 0, 0.0
    for _, o in ordered:
        cumulative += o
        summed += cumulative / total
    expected = (summed - (len(data) + 1) / 2) / len(data)
    assert evaluate.gini(scored(spark, data)).first()["gini"] == pytest.approx(expected)


def test_gains_end_at_one_and_weighted_lift_too(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_quantity").alias("predicted"), (F.col("l_returnflag") == "R").cast("int").alias("observed"))
    assert evaluate.gains(df).filter("quantile = 1").first()["gains"] == pytest.approx(1.0)
    last = evaluate.cumulative_lift(df, weighted=True).filter("quantile = 1").first()
    assert last["cumulative_lift"] == pytest.approx(1.0)


# ---- places

def test_distances(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 0.0), (0.0, 179.5, 0.0, -179.5), (90.0, 0.0, -90.0, 0.0), (None, 0.0, 0.0, 0.0)],
        "a double, b double, c double, d double")
    same, line, poles, none = [r[4] for r in geo.with_distance(df, "a", "b", "c", "d").collect()]
    assert same == 0 and line == pytest.approx(111.19, abs=0.01) and none is None
    assert poles == pytest.approx(math.pi * 6371)


def test_bearings(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0), (0.0, 0.0, 0.0, 10.0), (0.0, 0.0, 0.0, -10.0)],
                               "a double, b double, c double, d double")
    assert [round(r[4], 6) for r in geo.with_bearing(df, "a", "b", "c", "d").collect()] == [0.0, 90.0, 270.0]


def test_geohash_of_a_known_point(spark):
    # 57.64911, 10.40744 is the textbook example u4pruydqqvj
    df = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    assert df.select(geography.geohash("lat", "lon", 11)).first()[0] == "u4pruydqqvj"


@pytest.mark.parametrize("km", [40.0, 700.0, 9000.0])
def test_pairs_within_a_distance_against_all_pairs(spark, km):
    places = [(i, -90 + i * 37 % 181, -180 + i * 53 % 361) for i in range(120)]
    places += [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 0.0, 180.0), (203, 0.0, -180.0), (204, 0.1, 179.9)]
    df = spark.createDataFrame([(i, float(a), float(o)) for i, a, o in places],
                               "id long, latitude double, longitude double")
    got = geo.within_distance(df.withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r"), km, "l", "r")

    def distance(a, b):
        p, q = map(math.radians, (a[1], b[1]))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    expected = sorted((a[0], b[0]) for a in places for b in places if distance(a, b) <= km)
    assert [r[:2] for r in rows(got, "l", "r")] == expected


def test_pairs_within_a_distance_are_spread_over_tasks(spark):
    places = spark.range(0, 400, numPartitions=1).select(
        "id", (F.col("id") % 20).cast("double").alias("latitude"), F.lit(5.0).alias("longitude"))
    got = geo.within_distance(places.withColumnRenamed("id", "l"), places.withColumnRenamed("id", "r"), 50.0, "l", "r")
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert (sum(r["count"] for r in tasks), len(tasks)) == (20 * 20 * 20, 4)


# ---- training

def test_early_stopping_needs_no_more_rounds(spark):
    df = spark.range(60).selectExpr("id", "id % 2 AS f", "double(id % 7) AS x", "double(id % 7) AS y")
    models = training.fit_folds(df, ["x"], "y", "f", k=2, max_iter=4, stop_early=True, stepSize=1.0)
    assert all(m.getNumTrees <= 4 for m in models.values())
    scores = training.out_of_fold_scores(df, training.compiled(models, ["x"]), "id", "y", "f")
    assert scores.count() == 60 and training.fold_r2(scores).filter("r2 > 0.9").count() == 2


def test_training_tasks_do_not_grow_with_the_shuffle_partitions(spark, partitions, monkeypatch):
    from catalog import models

    rows = spark.range(40).selectExpr("id as reference_id", "1 as in_train", "id * 1.0D as response", "id as x")
    monkeypatch.setattr(models, "_table", lambda *_: rows)
    monkeypatch.setattr(models, "_models", {})
    monkeypatch.setattr(training, "fit_folds", lambda *_, **options: options["partitions"])
    found = []
    for n in (3, 400):
        partitions(n)
        found.append(models._fitted(spark, f"made up {n}")[3])
    assert found == [3, 2 * spark.sparkContext.defaultParallelism]


def _boosting_table(spark):
    return spark.range(90).selectExpr("id", "id % 3 AS f", "double(id % 7) AS x", "double(id % 11) AS z", "double(id % 7) AS y")


def test_folds_of_a_large_table_are_fitted_one_by_one(spark, monkeypatch):
    df, running, most, fit = _boosting_table(spark), [], [], training.GBTRegressor.fit

    def counted(self, *args):
        running.append(1)
        most.append(len(running))
        try:
            return fit(self, *args)
        finally:
            running.pop()

    monkeypatch.setattr(training.GBTRegressor, "fit", counted)
    together = training.fit_folds(df, ["x", "z"], "y", "f", k=3, max_iter=3)
    del most[:]
    monkeypatch.setattr(training, "ROWS_AT_ONCE", 100)
    alone = training.fit_folds(df, ["x", "z"], "y", "f", k=3, max_iter=3)
    assert most == [1, 1, 1]
    assert [alone[i].toDebugString.split("\n", 1)[1] for i in range(3)] == [
        together[i].toDebugString.split("\n", 1)[1] for i in range(3)]


def test_folds_at_once_fall_with_the_rows():
    assert [training.folds_at_once(n, 5) for n in (0, 1_000, 2_000_000, 4_000_000, 30_000_000)] == [5, 5, 2, 1, 1]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("write", [sizing.materialise, lambda df: sizing.bucketed(df, "k")])
def test_written_tables_leave_no_shuffle_files(spark, write):
    before = _shuffle_files(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    table = write(spark.range(1000).selectExpr("id % 50 AS k").groupBy("k").count())
    for _ in range(100):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert (table.count(), left, spark.conf.get(name)) == (50, set(), setting)


def test_noted_tables_can_be_deleted(spark):
    with sizing.tables_noted() as noted:
        sizing.materialise(spark.range(5))
        name = sizing.bucketed(spark.range(5), "id").inputFiles()[0].rsplit("/", 2)[-2]
    kept = sizing.materialise(spark.range(7))
    assert len(noted) == 2 and all(os.path.isdir(path) for path in noted) and spark.catalog.tableExists(name)
    sizing.forget(spark, noted)
    assert not any(os.path.exists(path) for path in noted) and not spark.catalog.tableExists(name)
    sizing.forget(spark, noted)
    assert kept.count() == 7


def test_the_model_table_leaves_nothing_but_itself(spark, folder, monkeypatch):
    from catalog import models

    monkeypatch.setattr(models, "_tables", {})
    before = set(os.listdir(sizing.shared_folder(spark)))
    table = models._table(spark, folder)
    new = set(os.listdir(sizing.shared_folder(spark))) - before
    assert new == {table.inputFiles()[0].rsplit("/", 2)[-2]}


def test_only_lines_up_to_the_decision_move_on(spark, folder, monkeypatch):
    from catalog import feature_tables

    class Seen(Exception):
        pass

    def seen(status, milestones, comments, decisions, *_):
        late = [log.join(decisions, "reference_id", "left").filter(
            "decision_time IS NULL OR seconds_since_case_start > decision_time").count() for log, _ in (status, milestones)]
        raise Seen(late, status[0].count() > 0 and milestones[0].count() > 0)

    monkeypatch.setattr(feature_tables.model, "case_features", seen)
    with pytest.raises(Seen) as found:
        feature_tables.model_rows(spark, folder)
    assert found.value.args == ([0, 0], True)


def test_vectors_are_planned_without_methods_too_large_to_compile(spark, monkeypatch):
    df, found = _boosting_table(spark), []
    limit, persist = "spark.sql.codegen.hugeMethodLimit", type(df).persist
    before = spark.conf.get(limit)

    def seen(self, *args):
        found.append(spark.conf.get(limit))
        return persist(self, *args)

    monkeypatch.setattr(type(df), "persist", seen)
    training.fit_folds(df, ["x"], "y", "f", k=3, max_iter=1)
    assert (found, spark.conf.get(limit)) == (["8000"], before)


def test_scores_of_a_feature_with_nulls(spark):
    df = spark.createDataFrame([(i, i % 2, None if i % 3 else 1.0, float(i % 3 == 0)) for i in range(40)],
                               "id long, f int, x double, y double")
    models = training.compiled(training.fit_folds(df, ["x"], "y", "f", k=2, max_iter=2), ["x"])
    scores = training.fold_scores(df, models, "id")
    assert scores.count() == 80 and scores.filter("prediction IS NULL").count() == 0


def test_trees_as_sql_score_like_the_model(spark):
    df = spark.range(400).selectExpr(
        "id", "id % 3 AS f", "CASE WHEN id % 11 > 0 THEN CAST(id * 37 % 101 AS DECIMAL(9, 2)) / 7 END AS `a b`",
        "CASE WHEN id % 13 = 0 THEN double('NaN') ELSE sin(id) END AS s", "id % 2 = 0 AS even",
        "sin(id) * 3 + id % 5 + id * 37 % 101 / 9.0 AS y")
    features = ["a b", "s", "even"]
    models = training.fit_folds(df, features, "y", "f", k=3, max_iter=20)
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(training._numbers(df, features))
    for i, trees in training.compiled(models, features).items():
        assert len(trees.weights) == 20 and Trees.from_json(trees.to_json()).sql({0: "p", 1: "q", 2: "r"}) == trees.sql(
            {0: "p", 1: "q", 2: "r"})
        theirs = {r["id"]: r["prediction"] for r in models[i].transform(ready).collect()}
        scored = training._score(df, trees, ["id"])
        assert "*(" in scored._jdf.queryExecution().executedPlan().toString()  # stays in code generation
        for mine in (scored, df.select("id", trees.column().alias("prediction"))):
            assert all(abs(r["prediction"] - theirs[r["id"]]) < 1e-12 for r in mine.collect())
    lone = training._score(df.selectExpr("id", "y AS prediction", "s"), Trees(("s",), (2.0,), ([0, 0.0, 1.0, 3.0],)), ["id"])
    assert {r["prediction"] for r in lone.collect()} == {2.0, 6.0}


# ---- files

def test_csv_without_a_schema_is_inferred_and_pipe_is_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b")], "n int, s string")
    files.write_csv(df, str(tmp_path / "c"))
    files.write_csv(df, str(tmp_path / "p"), sep=files.PIPE, n_files=1)
    assert files.read_csv(spark, str(tmp_path / "c")).dtypes == [("n", "int"), ("s", "string")]
    assert files.read_delimited(spark, str(tmp_path / "p")).dtypes == [("n", "string"), ("s", "string")]
    assert files.read_delimited(spark, str(tmp_path / "p")).first() == ("1", "a,b")


@pytest.mark.parametrize("path, fold", [("fold_1/scores/part", 1), ("manifold_3/fold_2", 2), ("fold=4", 4), ("fold_0/scores_fold_7", 7),
                                        ("fold_5/manifold_3", 5)])
def test_fold_comes_from_the_last_part_named_so(spark, tmp_path, path, fold):
    spark.createDataFrame([(1, 0.5)], "id int, p double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/{path}")
    found = files.read_fold_scores(spark, [f"{tmp_path}/{path}"], "id int, p double")
    assert [r["fold"] for r in found.collect()] == [fold]


# ---- model tables

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_model_table_reads_its_buckets_without_a_shuffle(spark, folder):
    from catalog import QUERIES

    assert "Exchange" not in _plan(QUERIES["row_model_table"](spark, folder))


def _logs(spark):
    status = spark.createDataFrame([(1, 0, "1 low", 1), (1, 50, "2 high", 1), (1, 99, "3", 1), (2, 5, "4 x", 1)],
                                   "id long, t long, severity string, tie int")
    milestones = spark.createDataFrame([(1, 10, 7, "a b", "6763", "u", 1), (1, 20, 8, "a", "x y", "v", 1), (3, 1, 7, "a", None, "v", 1)],
                                       "id long, t long, milestone_id int, milestone_description string, note_description string, "
                                       "updated_by string, tie int")
    comments = spark.createDataFrame([(2, 1, "web", "n1 n2", 5, "me", 1), (2, 4, "mail", None, 5, "you", 2)],
                                     "id long, t long, comment_type string, notes string, global_id int, created_by string, tie int")
    log = EventLog("id", "t", ("tie",))
    decisions = spark.createDataFrame([(1, 60), (2, 9), (3, 9), (4, 9)], "id long, decision_time long")
    return (status, log), (milestones, log), (comments, log), decisions


@pytest.mark.parametrize("hot", [{}, None])
def test_case_features_of_three_logs(spark, hot, request):
    if hot is None:
        request.getfixturevalue("everything_hot")
    cases = model_table.case_features(*_logs(spark), types=["web"], hot=hot)
    found = {r["id"]: r.asDict() for r in cases.collect()}
    assert set(found) == {1, 2, 3}
    one, two, three = (found[i] for i in (1, 2, 3))
    assert (one["initial_case_severity_level"], one["cutoff_case_severity_level"]) == (1, 2)
    assert one["last_label_encoded_milestone_description"] == 1 and one["max_label_encoded_milestone_description"] == 2
    assert one["proportion_is_milestone_note_6763"] == 0.5 and one["last_milestone_id"] == 8
    assert one["cutoff_seconds_since_previous_milestone"] == 10 / 86400
    assert one["unique_comments"] is None and one["last_comment_time"] is None and two["unique_comments"] == 2
    assert two["proportion_comment_type_is_web"] == 0.5 and two["first_label_encoded_notes"] == 1
    assert two["last_label_encoded_notes"] is None and two["comment_frequency"] == 3 / 86400
    assert two["unique_number_of_milestone_ids"] is None and three["initial_case_severity_level"] is None
    assert three["last_length_of_note_description_null_for_6763"] == -999 and three["last_label_encoded_updated_by"] == 1
    if hot == {}:
        assert "Exchange hashpartitioning(id" not in _plan(cases)  # the only shuffle of events is behind the written table


def test_prior_counts_keep_no_wide_rows(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 5, "b")], "k int, t long, v string")
    log = EventLog("k", "t")
    assert "Aggregate" not in _plan(history.pivot_counts(df, log, "v", ["a", "b"], {}))
    # the events, and the moments twice
    plan = _plan(history.prior_counts(df, log, "v", hot={}))
    assert plan.count("Exchange") - plan.count("BroadcastExchange") - plan.count("ReusedExchange") <= 4, plan


def test_row_model_table_both_ways(spark, everything_hot):
    events = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 9, "a"), (None, 1, "a"), (2, None, "a")], "id long, t long, c string")
    asked = spark.createDataFrame([(1, 4, 0), (1, 5, 0), (1, 9, 1), (1, 9, 2), (1, 12, 3), (2, 1, 4), (None, 3, 5), (1, None, 6)],
                                  "id long, t long, n int")
    log = EventLog("id", "t")
    plain, ranged = (sorted(map(str, model_table.row_model_table(asked, events, log, "c", ["a", "b"], hot).collect()))
                     for hot in ({}, None))
    assert plain == ranged and len(plain) == 8
    assert any("n=3, total=2, count_a=1" in r and "seconds_to_closest_milestone_features=3" in r for r in plain)


@pytest.mark.parametrize("hot", [{}, None])
def test_prior_counts_at_given_times_and_with_null_keys(spark, hot, everything_hot):
    events = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 9, "a"), (None, 1, "a"), (None, 2, None), (1, None, "a")],
                                   "id long, t long, c string")
    log = EventLog("id", "t")
    own = rows(history.prior_counts(events, log, "c", hot=hot))
    assert own == [(None, 2, "a", 1, 1, 1), (1, 9, "a", 1, 5, 5), (1, 9, "b", 1, 5, 5)]
    at = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (1, 20), (3, 9)], "id long, t long")
    assert rows(history.prior_counts(events, log, "c", at=at, hot=hot)) == [
        (1, 6, "a", 1, 5, 5), (1, 6, "b", 1, 5, 5), (1, 20, "a", 2, 5, 9), (1, 20, "b", 1, 5, 5)]
    assert rows(history.prior_counts(events, log, "c", ["b"], hot)) == [(1, 9, "b", 1, 5, 5)]


@pytest.mark.parametrize("n_events", [None, 10_000_000])
def test_buckets_of_cases_grow_with_the_rows(spark, monkeypatch, n_events):
    from casebook.operators import sizing

    made, bucketed = [], model_table.bucketed
    monkeypatch.setattr(model_table, "bucketed", lambda *args: made.append(bucketed(*args)) or made[-1])
    monkeypatch.setattr(sizing, "BUCKET_ROWS", 1 if n_events is None else 500_000)
    logs = _logs(spark)
    before = spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    cases = model_table.case_features(*logs, types=["web"], hot={}, n_events=n_events)
    rows = sum(log.count() for log, _ in logs[:3])
    wanted = 4 * -(-rows // 4) if n_events is None else 20
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {_table_name(made[0])}").collect()}
    assert int(described["Num Buckets"]) == wanted
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == before
    assert {r["id"] for r in cases.collect()} == {1, 2, 3}


def _table_name(df):
    return next(word for file in df.inputFiles() for word in file.split("/") if word.startswith("bucketed_"))
