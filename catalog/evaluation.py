"""Predicted against observed."""

from __future__ import annotations

from casebook.operators import evaluate
from catalog.fixtures import LINE_TIES, PRICED, classified, classified_sql, priced
from catalog.registry import query, rounded, with_

SCORED = classified_sql()
TIES = ("l_orderkey", *LINE_TIES)
ID = ", ".join(TIES)


def binned_sql(name: str, source: str, q: int = 10) -> str:
    return f"""{name} AS (
  SELECT *, (((2 * before + cnt + 1) * {q} + 2 * total - 1) // (2 * total))::INTEGER AS quantile FROM (
    SELECT *, rank() OVER (ORDER BY predicted) - 1 AS before, count(*) OVER (PARTITION BY predicted) AS cnt,
      count(*) OVER () AS total FROM {source}))"""


def lifts_sql(name: str, binned: str, q: int = 10) -> str:
    return f"""{name} AS (
  SELECT *, avg(lift) OVER (ORDER BY quantile DESC ROWS UNBOUNDED PRECEDING) AS cumulative_lift FROM (
    SELECT quantile, (quantile - 0.5::DOUBLE) / {q} AS quantile_mid,
      avg(observed) / (SELECT avg(observed) FROM {binned}) AS lift, sum(observed) AS s
    FROM {binned} GROUP BY quantile))"""


BINNED = binned_sql("binned", "scored")
LIFTS = lifts_sql("lifts", "binned")


@query(with_(SCORED, BINNED, select=f"""
SELECT {ID}, predicted, observed, round((before + (cnt + 1) / 2) / total, 8) AS predicted_percent_rank, quantile,
  round((quantile - 0.5::DOUBLE) / 10, 6) AS quantile_mid, round(abs(predicted - observed), 6) AS error FROM binned"""))
def row_table(spark, folder):
    return rounded(evaluate.row_table(classified(spark, folder)), {"predicted_percent_rank": 8})


@query(with_(PRICED, BINNED, select="""
SELECT quantile, round((quantile - 0.5::DOUBLE) / 10, 6) AS quantile_mid, round(avg(predicted), 3) AS predicted,
  round(avg(observed), 3) AS observed, round(avg(predicted) - avg(observed), 3) AS error
FROM binned GROUP BY quantile"""))
def pvo(spark, folder):
    scored = priced(spark, folder).select("predicted", "observed")
    return rounded(evaluate.pvo_error(scored), {"predicted": 3, "observed": 3, "error": 3})


@query(with_(SCORED, BINNED, LIFTS, select="""
SELECT quantile, round(quantile_mid, 6) AS quantile_mid, round(lift, 6) AS lift,
  round(cumulative_lift, 6) AS cumulative_lift,
  round(sum(s) OVER (ORDER BY quantile DESC ROWS UNBOUNDED PRECEDING) / sum(s) OVER (), 6) AS gains
FROM lifts"""))
def lift_gains(spark, folder):
    scored = classified(spark, folder).select("predicted", "observed")
    return rounded(evaluate.curves(scored).drop("weighted_cumulative_lift"))


GINI = f"""ranked AS (
  SELECT observed, row_number() OVER (ORDER BY predicted DESC, {ID}, observed) AS pos,
    row_number() OVER (ORDER BY observed DESC) AS best, count(*) OVER () AS n FROM scored)""", """ginis AS (
  SELECT (sum(observed * (n - pos + 1)) / sum(observed) - (max(n) + 1) / 2) / max(n) AS gini,
    (sum(observed * (n - best + 1)) / sum(observed) - (max(n) + 1) / 2) / max(n) AS best FROM ranked)"""


@query(with_(SCORED, *GINI, select="""
SELECT round(gini, 6) AS gini, round(gini / best, 6) AS normalised_gini FROM ginis"""))
def gini(spark, folder):
    return rounded(evaluate.gini(classified(spark, folder), TIES))


AUC = """aucs AS (
  SELECT (sum(observed * (before + (cnt + 1) / 2)) - sum(observed) * (sum(observed) + 1) / 2)
    / (sum(observed) * (count(*) - sum(observed))) AS auc FROM binned)"""
LOG_LOSS = """losses AS (
  SELECT avg(-(observed * ln(p) + (1 - observed) * ln(1 - p))) AS log_loss FROM (
    SELECT observed, least(greatest(predicted, 1e-15), 1 - 1e-15::DOUBLE) AS p FROM scored))"""


@query(with_(SCORED, BINNED, AUC, select="SELECT round(auc, 6) AS auc FROM aucs"))
def auc(spark, folder):
    return rounded(evaluate.auc(classified(spark, folder)))


@query(with_(SCORED, LOG_LOSS, select="SELECT round(log_loss, 6) AS log_loss FROM losses"))
def log_loss(spark, folder):
    return rounded(evaluate.log_loss(classified(spark, folder)))


@query(with_(SCORED, select="""
SELECT round(sum(observed) FILTER (predicted > 0.1) / count(*) FILTER (predicted > 0.1), 6) AS precision,
  round(sum(observed) FILTER (predicted > 0.1) / sum(observed), 6) AS recall FROM scored"""))
def precision_recall(spark, folder):
    return rounded(evaluate.precision_recall(classified(spark, folder), 0.1))


@query(with_(PRICED, select="""
SELECT round(avg((predicted - observed) ** 2), 1) AS mse, round(sqrt(avg((predicted - observed) ** 2)), 4) AS rmse,
  round(avg(abs(predicted - observed)), 4) AS mae,
  round(1 - avg((predicted - observed) ** 2) / var_pop(observed), 6) AS r2 FROM scored"""))
def regression_metrics(spark, folder):
    return rounded(evaluate.regression_metrics(priced(spark, folder)), {"mse": 1, "rmse": 4, "mae": 4})


@query(with_(PRICED, """m AS (
  SELECT avg((predicted - observed) ** 2) AS mse, avg(abs(predicted - observed)) AS mae FROM scored)""", select="""
SELECT 'rmse' AS metric, round(sqrt(mse), 2) AS value FROM m UNION ALL SELECT 'mse', round(mse, 2) FROM m
UNION ALL SELECT 'mae', round(mae, 2) FROM m"""))
def metric_bundle(spark, folder):
    return rounded(evaluate.metrics(priced(spark, folder), "regression"), 2)


def metrics_sql(name: str, score: str) -> tuple[str, ...]:
    """The metric bundle of one classifier, with its parts under names of its own."""
    parts = (classified_sql("scored", score), BINNED, *GINI, AUC, LOG_LOSS)
    return f"""{name} AS (
WITH {', '.join(parts)}
SELECT 'gini' AS metric, gini AS value FROM ginis UNION ALL SELECT 'normalised_gini', gini / best FROM ginis
UNION ALL SELECT 'auc', auc FROM aucs UNION ALL SELECT 'log_loss', log_loss FROM losses)"""


@query(with_(metrics_sql("a", "a"), metrics_sql("b", "b"), select="""
SELECT metric, round(a.value, 6) AS baseline_model_metric, round(b.value, 6) AS uplift_model_metric,
  round(b.value - a.value, 6) AS absolute_uplift, round(b.value / a.value, 4) AS relative_uplift
FROM a JOIN b USING (metric)"""))
def uplift(spark, folder):
    a, b = (evaluate.metrics(classified(spark, folder, s), ties=TIES) for s in "ab")
    return rounded(evaluate.uplift(a, b), {"relative_uplift": 4})


@query(with_(classified_sql("scored_a", "a"), classified_sql("scored_b", "b"), binned_sql("binned_a", "scored_a"),
             binned_sql("binned_b", "scored_b"), lifts_sql("a", "binned_a"), lifts_sql("b", "binned_b"), select="""
SELECT quantile, round((quantile - 0.5::DOUBLE) / 10, 6) AS quantile_mid,
  round(b.cumulative_lift / a.cumulative_lift, 6) AS relative_uplift FROM a FULL JOIN b USING (quantile)"""))
def uplift_by_quantile(spark, folder):
    a, b = (classified(spark, folder, s).select("predicted", "observed") for s in "ab")
    return rounded(evaluate.uplift_by_quantile(a, b))


@query(with_(classified_sql("scored", "b"), select="""
SELECT observed, least(floor(predicted * 20) + 1, 21)::INTEGER AS bin, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY observed), 6) AS share
FROM scored GROUP BY observed, bin"""))
def score_histogram(spark, folder):
    return rounded(evaluate.score_histogram(classified(spark, folder, "b")))


@query(with_(PRICED, select="""
SELECT CASE WHEN e < -40000 THEN 0 ELSE least(floor((e + 40000) / 4000) + 1, 21) END::INTEGER AS bin, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT predicted - observed AS e FROM scored) GROUP BY bin"""))
def error_histogram(spark, folder):
    return rounded(evaluate.error_histogram(priced(spark, folder), -40000.0, 40000.0))
