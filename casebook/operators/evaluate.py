"""Predicted against observed, from a table with columns ``predicted`` and ``observed``.

Ranks come from the distinct scores and their counts (:mod:`casebook.operators.rank`), so quantile tables and AUC never
sort or collect the scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.operators.clean import union_all
from casebook.operators.rank import rank_table
from casebook.operators.sizing import lookup_join

PREDICTED, OBSERVED = "predicted", "observed"
LOG_LOSS_CLIP = 1e-15  # fixed value: probabilities are clipped to [clip, 1 - clip]


def quantile(q: int) -> Column:
    """Equal-width bin 1..q of the average-method percent rank, in whole numbers."""
    return F.expr(f"((2 * before + cnt + 1) * {q} + 2 * total - 1) div (2 * total)").cast("int")


def _mid(bin_column: str, q: int) -> Column:
    return (F.col(bin_column) - 0.5) / q


def row_table(scored: DataFrame, q: int = 10) -> DataFrame:
    """Add ``predicted_percent_rank``, ``quantile``, ``quantile_mid`` and the absolute ``error`` to every row."""
    ranks = rank_table(scored, PREDICTED).select(
        PREDICTED,
        ((F.col("before") + (F.col("cnt") + 1) / 2) / F.col("total")).alias("predicted_percent_rank"),
        quantile(q).alias("quantile"),
    )
    rows = lookup_join(scored, ranks, PREDICTED, "left", null_safe=True)
    return rows.withColumns({"quantile_mid": _mid("quantile", q), "error": F.abs(F.col(PREDICTED) - F.col(OBSERVED))})


def quantile_table(scored: DataFrame, q: int = 10) -> DataFrame:
    """At most q rows: ``n``, mean predicted and observed, summed observed, population mean and total."""
    counted = scored.withColumn("_has_observed", F.col(OBSERVED).isNotNull().cast("int"))
    ranked = rank_table(counted, PREDICTED, obs=OBSERVED, n_obs="_has_observed")
    bins = ranked.groupBy(quantile(q).alias("quantile")).agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col(PREDICTED) * F.col("cnt")) / F.sum("cnt")).alias("mean_predicted"),
        F.try_divide(F.sum("obs"), F.sum("n_obs")).alias("mean_observed"),
        F.sum("obs").alias("sum_observed"),
        F.max("total_obs").alias("total_observed"),
        F.try_divide(F.max("total_obs"), F.max("total_n_obs")).alias("population_mean"),
    )
    return bins.withColumn("quantile_mid", _mid("quantile", q))


def pvo(scored: DataFrame, q: int = 10) -> DataFrame:
    """Mean predicted and mean observed per quantile."""
    return quantile_table(scored, q).select(
        "quantile", "quantile_mid", F.col("mean_predicted").alias(PREDICTED), F.col("mean_observed").alias(OBSERVED)
    )


def pvo_error(scored: DataFrame, q: int = 10) -> DataFrame:
    """Mean predicted minus mean observed per quantile."""
    return pvo(scored, q).withColumn("error", F.col(PREDICTED) - F.col(OBSERVED))


def row_error(scored: DataFrame) -> DataFrame:
    """Add ``prediction_error``, predicted minus observed."""
    return scored.withColumn("prediction_error", F.col(PREDICTED) - F.col(OBSERVED))


def curves(scored: DataFrame, q: int = 10) -> DataFrame:
    """Lift, cumulative lift (plain and weighted by rows) and gains per quantile, from one quantile table."""
    # over a quantile table: at most q rows
    top_first = Window.orderBy(F.desc("quantile")).rowsBetween(Window.unboundedPreceding, 0)
    table = quantile_table(scored, q).withColumn(
        "lift", F.try_divide(F.col("mean_observed"), F.col("population_mean")))
    weighted = F.sum(F.col("lift") * F.col("n")).over(top_first) / F.sum("n").over(top_first)
    return table.select(
        "quantile", "quantile_mid", "lift",
        F.avg("lift").over(top_first).alias("cumulative_lift"),
        weighted.alias("weighted_cumulative_lift"),
        F.try_divide(F.sum("sum_observed").over(top_first), F.col("total_observed")).alias("gains"),
    )


def lift(scored: DataFrame, q: int = 10) -> DataFrame:
    """Mean observed per quantile over the population mean."""
    return curves(scored, q).select("quantile", "quantile_mid", "lift")


def cumulative_lift(scored: DataFrame, q: int = 10, weighted: bool = False) -> DataFrame:
    """Mean lift of a quantile and all higher ones: of the lifts themselves, or weighted by rows."""
    mean = F.col("weighted_cumulative_lift" if weighted else "cumulative_lift")
    return curves(scored, q).select("quantile", "quantile_mid", "lift", mean.alias("cumulative_lift"))


def gains(scored: DataFrame, q: int = 10) -> DataFrame:
    """Share of the total observed that lies in a quantile and all higher ones."""
    return curves(scored, q).select("quantile", "quantile_mid", "gains")


def _gini(ranked: DataFrame) -> Column:
    """Gini from rows that share ``observed`` per key, keys in order of falling prediction.

    The cumulative sums of observed add up to the sum of observed times the number of rows from there on.
    """
    cnt = F.col("cnt")
    after = cnt * (F.col("total") - F.col("before") + 1) - cnt * (cnt + 1) / 2
    n = F.max("total")
    summed = F.try_divide(F.sum(F.col(OBSERVED) * after), F.sum(F.col(OBSERVED) * cnt))
    return (summed - (n + 1) / 2) / n


def _labelled(scored: DataFrame) -> DataFrame:
    """Rows with both a prediction and an observed value; the others say nothing about a model."""
    return scored.filter(F.col(PREDICTED).isNotNull() & F.col(OBSERVED).isNotNull())


def gini(scored: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One row: ``gini`` and ``normalised_gini``. Equal predictions are ordered by ``ties``, then by observed."""
    scored = _labelled(scored)
    rows = scored.select((-F.col(PREDICTED)).alias("_falling"), *ties, OBSERVED)
    own = rank_table(rows, ["_falling", *[t for t in ties if t != OBSERVED], OBSERVED])
    best = rank_table(scored.select((-F.col(OBSERVED)).alias("_falling"), OBSERVED), ["_falling", OBSERVED])
    top = best.agg(_gini(best).alias("gini")).scalar()
    return own.agg(_gini(own).alias("gini")).withColumn("normalised_gini", F.try_divide(F.col("gini"), top))


def auc(scored: DataFrame) -> DataFrame:
    """One row: the area under the ROC curve by the rank sum; null when only one class is there."""
    ranked = rank_table(_labelled(scored), PREDICTED, positives=OBSERVED)
    positives = F.max("total_positives").cast("double")
    negatives = F.max("total") - positives
    rank_sum = F.sum(F.col("positives") * (F.col("before") + (F.col("cnt") + 1) / 2))
    return ranked.agg(
        F.try_divide(rank_sum - positives * (positives + 1) / 2, positives * negatives).alias("auc")
    )


def log_loss(scored: DataFrame) -> DataFrame:
    """One row: mean log loss, probabilities clipped to stay off 0 and 1."""
    p = F.least(F.greatest(F.col(PREDICTED), F.lit(LOG_LOSS_CLIP)), F.lit(1 - LOG_LOSS_CLIP))
    loss = -(F.col(OBSERVED) * F.ln(p) + (1 - F.col(OBSERVED)) * F.ln(1 - p))
    return scored.agg(F.avg(loss).alias("log_loss"))


def threshold_label(threshold: float = 0.5) -> Column:
    """1 for predictions above the threshold."""
    return F.when(F.col(PREDICTED) > threshold, 1).otherwise(0)


def precision_recall(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: precision and recall at a threshold; 0 when there is nothing to divide by."""
    label = threshold_label(threshold)
    hits = F.sum(label * F.col(OBSERVED))
    zero = F.lit(0.0)
    return _labelled(scored).agg(
        F.coalesce(F.try_divide(hits, F.sum(label)), zero).alias("precision"),
        F.coalesce(F.try_divide(hits, F.sum(OBSERVED)), zero).alias("recall"),
    )


def regression_metrics(scored: DataFrame) -> DataFrame:
    """One row: mse, rmse, mae and r2 (null when observed does not vary)."""
    error = F.col(PREDICTED) - F.col(OBSERVED)
    mse = F.avg(error * error)
    return _labelled(scored).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(OBSERVED))).alias("r2"),
    )


def metrics(scored: DataFrame, kind: str = "classification", ties: Sequence[str] = ()) -> DataFrame:
    """The metric bundle as rows ``(metric, value)``."""
    if kind == "regression":
        tables = [regression_metrics(scored).select("rmse", "mse", "mae")]
    else:
        tables = [gini(scored, ties), auc(scored), log_loss(scored)]
    return union_all([t.unpivot([], t.columns, "metric", "value") for t in tables])


def uplift(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two ``(metric, value)`` tables side by side, with the absolute and the relative uplift."""
    return (
        baseline.withColumnRenamed("value", "baseline_model_metric")
        .join(candidate.withColumnRenamed("value", "uplift_model_metric"), "metric")
        .withColumn("absolute_uplift", F.col("uplift_model_metric") - F.col("baseline_model_metric"))
        .withColumn("relative_uplift", F.try_divide(F.col("uplift_model_metric"), F.col("baseline_model_metric")))
    )


def uplift_by_quantile(baseline: DataFrame, candidate: DataFrame, q: int = 10) -> DataFrame:
    """Ratio of the cumulative lifts per quantile; null where one model has no rows in it."""
    old, new = (cumulative_lift(s, q).select("quantile", F.col("cumulative_lift").alias(n))
                for s, n in ((baseline, "baseline"), (candidate, "uplift")))
    ratio = F.try_divide(F.col("uplift"), F.col("baseline"))
    return old.join(new, "quantile", "full").select(
        "quantile", _mid("quantile", q).alias("quantile_mid"), ratio.alias("relative_uplift")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin (0 below ``low``, n_bins + 1 from ``high`` on) and their share of the group."""
    bins = df.groupBy(*by, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n_bins)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"))
    # at most n_bins + 2 rows per group
    return bins.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def score_histogram(scored: DataFrame, low: float = 0.0, high: float = 1.0, n_bins: int = 20) -> DataFrame:
    """Scores of each observed class."""
    return histogram(scored, PREDICTED, low, high, n_bins, [OBSERVED])


def error_histogram(scored: DataFrame, low: float, high: float, n_bins: int = 20) -> DataFrame:
    """Predicted minus observed."""
    return histogram(row_error(scored), "prediction_error", low, high, n_bins)
