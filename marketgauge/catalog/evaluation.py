"""Queries for metrics, curves and thresholds on deterministic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import evaluate, sampling
from .exploring import quantile_bins_sql
from .registry import q, query, rounded


def scored(t):
    """Label and a price-based score, so that results can be checked exactly."""
    return t.interactions.select(
        "lineID", "pid", "day", "price", F.col("order").alias("label"),
        (F.lit(1) / (F.lit(1) + F.col("price") / 1000)).alias("score"))


CURVE = """
curve AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1),
run AS (SELECT score, p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn,
  sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM curve
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("roc_auc", f"WITH {CURVE} SELECT {q('sum(n * (cp - p / 2)) / (any_value(tp) * any_value(tn))')}"
       " AS roc_auc FROM run", ("scored",))
def roc_auc(t):
    return rounded(evaluate.roc_auc(scored(t)))


@query("average_precision", f"""WITH {CURVE}
SELECT {q('sum(p * cp / (cp + cn)) / sum(p)')} AS average_precision FROM run""", ("scored",))
def average_precision(t):
    return rounded(evaluate.average_precision(scored(t)))


@query("roc_points", f"""WITH {CURVE}
SELECT {q('score', 12)} AS threshold, {q('cn / tn')} AS fpr, {q('cp / tp')} AS tpr FROM run""",
       ("scored",))
def roc_points(t):
    return rounded(evaluate.roc_points(scored(t)), threshold=12)


@query("pr_points", f"""WITH {CURVE}
SELECT {q('score', 12)} AS threshold, {q('cp / (cp + cn)')} AS precision, {q('cp / tp')} AS recall,
  {q('tp / (tp + tn)')} AS no_skill FROM run""", ("scored",))
def pr_points(t):
    return rounded(evaluate.pr_points(scored(t)), threshold=12)


@query("fold_metrics", f"""
WITH curve AS (SELECT pid % 5 AS fold, score, sum(label) AS p, sum(1 - label) AS n FROM scored
  GROUP BY 1, 2),
run AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM curve
  WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT fold, {q('sum(n * (cp - p / 2)) / (sum(p) * sum(n))')} AS roc_auc,
  {q('sum(p * cp / (cp + cn)) / sum(p)')} AS pr_auc FROM run GROUP BY 1""", ("scored",))
def fold_metrics(t):
    df = scored(t).withColumn("fold", F.col("pid") % 5)
    return rounded(evaluate.ranking_metrics(df, ["fold"]))


def at_sql(threshold: float, source: str, by: str = "") -> str:
    return f"""SELECT {by} count(*) FILTER (score >= {threshold} AND label = 1) AS tp,
  count(*) FILTER (score >= {threshold} AND label = 0) AS fp,
  count(*) FILTER (score < {threshold} AND label = 1) AS fn,
  count(*) FILTER (score < {threshold} AND label = 0) AS tn FROM {source}"""


PRF = f"""{q('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {q('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
  {q('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1"""


@query("binary_metrics", f"""
SELECT tp, fp, fn, tn, {q('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy,
  {q('(fp + fn) / (tp + tn + fp + fn)')} AS error, {PRF}
FROM ({at_sql(0.3, 'scored')})""", ("scored",))
def binary_metrics(t):
    return rounded(evaluate.binary_metrics(scored(t), 0.3))


@query("generalisation_gap", f"""
WITH e AS (SELECT day < 79 AS train, avg(((score >= 0.3) <> (label = 1))::INT) AS e FROM scored
  GROUP BY 1), w AS (SELECT max(e) FILTER (train) AS a, max(e) FILTER (NOT train) AS b FROM e)
SELECT {q('a')} AS train_error, {q('b')} AS test_error, {q('b - a')} AS gap FROM w""", ("scored",))
def generalisation_gap(t):
    return rounded(evaluate.gap_report(sampling.time_split(scored(t), [79]), 0.3))


def multiclass(t):
    """Action labels with a price-and-ad rule as prediction and fixed class probabilities."""
    action = (F.when(F.col("click") == 1, "click").when(F.col("basket") == 1, "basket")
              .otherwise("order"))
    guess = (F.when(F.col("price") < 1500, "order").when(F.col("adFlag") == 1, "basket")
             .otherwise("click"))
    p = F.lit(1) / (F.lit(1) + F.col("price") / 1000)
    return t.interactions.select(action.alias("label"), guess.alias("prediction"),
                                 ((1 - p) * 0.6).alias("p_click"),
                                 ((1 - p) * 0.4).alias("p_basket"), p.alias("p_order"))


MULTI = """
multi AS (SELECT CASE WHEN click = 1 THEN 'click' WHEN basket = 1 THEN 'basket' ELSE 'order' END
  AS label, CASE WHEN price < 1500 THEN 'order' WHEN "adFlag" = 1 THEN 'basket' ELSE 'click' END
  AS prediction, 1 / (1 + price / 1000) AS p FROM interactions),
classes AS (SELECT unnest(['click', 'basket', 'order']) AS c),
report AS (SELECT c AS class, count(*) FILTER (label = c AND prediction = c) AS tp,
  count(*) FILTER (label <> c AND prediction = c) AS fp,
  count(*) FILTER (label = c AND prediction <> c) AS fn FROM classes, multi GROUP BY 1)"""


@query("confusion_matrix", f"""
WITH {MULTI}
SELECT a.c AS label, b.c AS prediction, count(m.label) AS n,
  {q('count(m.label) / sum(count(m.label)) OVER (PARTITION BY a.c)')} AS share
FROM classes a CROSS JOIN classes b LEFT JOIN multi m ON m.label = a.c AND m.prediction = b.c
GROUP BY 1, 2""", ("interactions",))
def confusion_matrix(t):
    return rounded(evaluate.confusion(multiclass(t), schema.ACTIONS))


@query("class_report", f"""
WITH {MULTI} SELECT class, {PRF}, tp + fn AS support FROM report""", ("interactions",))
def class_report(t):
    return rounded(evaluate.class_report(multiclass(t), schema.ACTIONS))


@query("multiclass_metrics", f"""
WITH {MULTI}, f AS (SELECT tp / nullif(tp + fn, 0) AS r, tp + fn AS s,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM report)
SELECT {q('sum(r * s) / sum(s)')} AS accuracy, {q('avg(r)')} AS balanced_accuracy,
  {q('avg(f1)')} AS macro_f1, {q('sum(f1 * s) / sum(s)')} AS weighted_f1,
  {q('''(SELECT -avg(ln(CASE label WHEN 'order' THEN p WHEN 'click' THEN (1 - p) * 0.6
    ELSE (1 - p) * 0.4 END)) FROM multi)''')} AS log_loss FROM f""", ("interactions",))
def multiclass_metrics(t):
    names = {c: f"p_{c}" for c in schema.ACTIONS}
    return rounded(evaluate.multiclass_metrics(multiclass(t), schema.ACTIONS,
                                               probabilities=names))


def sweep_sql(start: float, step: float, count: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""
WITH grid AS (SELECT {start}::DOUBLE + i * {step}::DOUBLE AS threshold FROM range({count}) r(i)),
counts AS (SELECT {key}threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
  count(*) FILTER (score >= threshold AND label = 0) AS fp,
  count(*) FILTER (score < threshold AND label = 1) AS fn
  FROM scored, grid GROUP BY ALL),
swept AS (SELECT {key}{q('threshold')} AS threshold, tp, fp, fn, {PRF} FROM counts)"""


@query("threshold_sweep", sweep_sql(0.05, 0.01, 90) + " SELECT * FROM swept", ("scored",))
def threshold_sweep(t):
    return rounded(evaluate.threshold_sweep(scored(t), evaluate.sweep_grid()))


@query("best_threshold", sweep_sql(0.20, 0.05, 12) + """
SELECT threshold, precision, recall, f1 FROM swept
ORDER BY f1 DESC, precision DESC, recall DESC, threshold LIMIT 1""", ("scored",))
def best_threshold(t):
    sweep = rounded(evaluate.threshold_sweep(scored(t), evaluate.sweep_grid(0.20, 0.80, 0.05)))
    return evaluate.best_threshold(sweep)


@query("nearest_thresholds", sweep_sql(0.05, 0.01, 90) + """
SELECT p::DOUBLE AS point, s.* EXCLUDE (tp, fp, fn) FROM (VALUES (0.20), (0.24), (0.30), (0.40), (0.50)) v(p),
LATERAL (SELECT * FROM swept ORDER BY round(abs(threshold - p), 9), threshold LIMIT 1) s""",
       ("scored",))
def nearest_thresholds(t):
    sweep = rounded(evaluate.threshold_sweep(scored(t), evaluate.sweep_grid()))
    return evaluate.nearest(sweep, [0.20, 0.24, 0.30, 0.40, 0.50])


@query("threshold_cv", sweep_sql(0.0, 0.01, 101, "pid % 5 AS fold").replace(
    "SELECT pid % 5 AS fold, (round_even", "SELECT fold, (round_even") + f"""
SELECT threshold, {q('avg(f1)', 8)} AS mean_f1, {q('stddev_pop(f1)', 8)} AS std_f1
FROM swept GROUP BY 1""", ("scored",))
def threshold_cv(t):
    df = scored(t).withColumn("fold", F.col("pid") % 5)
    sweep = rounded(evaluate.threshold_sweep(df, evaluate.sweep_grid(0.0, 1.01, 0.01), ["fold"]))
    return rounded(evaluate.average_over_folds(sweep), mean_f1=8, std_f1=8)


@query("threshold_cv_choice", sweep_sql(0.0, 0.01, 101, "pid % 5 AS fold").replace(
    "SELECT pid % 5 AS fold, (round_even", "SELECT fold, (round_even") + f""",
means AS (SELECT threshold, {q('avg(f1)', 8)} AS mean_f1, {q('stddev_pop(f1)', 8)} AS std_f1
  FROM swept GROUP BY 1)
SELECT * FROM means ORDER BY mean_f1 DESC, threshold LIMIT 1""", ("scored",))
def threshold_cv_choice(t):
    df = scored(t).withColumn("fold", F.col("pid") % 5)
    sweep = rounded(evaluate.threshold_sweep(df, evaluate.sweep_grid(0.0, 1.01, 0.01), ["fold"]))
    return rounded(evaluate.choose_threshold(evaluate.average_over_folds(sweep)),
                   mean_f1=8, std_f1=8)


@query("binary_metrics_null_score", f"""
WITH n AS (SELECT label, CASE WHEN pid % 7 > 0 THEN score END AS score FROM scored)
SELECT c.*, {q('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy,
  {q('1 - (tp + tn) / (tp + fp + fn + tn)')} AS error, {PRF}
FROM (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (coalesce(score < 0.5, true) AND label = 1) AS fn,
  count(*) FILTER (coalesce(score < 0.5, true) AND label = 0) AS tn FROM n) c""", ("scored",))
def binary_metrics_null_score(t):
    df = scored(t).withColumn("score", F.when(F.col("pid") % 7 > 0, F.col("score")))
    return rounded(evaluate.binary_metrics(df, 0.5))


@query("operating_points", f"""
SELECT v.name AS operating_point, v.t::DOUBLE AS threshold, c.tp, c.fn, c.fp,
  {q('100.0 * (c.tp + c.fp) / (c.tp + c.fp + c.fn + c.tn)')} AS flagged_pct, {PRF}
FROM (VALUES ('Default', 0.50), ('Balanced', 0.23), ('Recall-leaning', 0.20)) v(name, t),
LATERAL (SELECT count(*) FILTER (score >= t AND label = 1) AS tp,
  count(*) FILTER (score >= t AND label = 0) AS fp,
  count(*) FILTER (score < t AND label = 1) AS fn,
  count(*) FILTER (score < t AND label = 0) AS tn FROM scored) c""", ("scored",))
def operating_points(t):
    return rounded(evaluate.operating_points(scored(t)))


@query("brier_score", f"SELECT {q('avg((score - label) ** 2)')} AS brier FROM scored",
       ("scored",))
def brier_score(t):
    return rounded(evaluate.brier(scored(t)))


@query("calibration_curve", f"""
WITH {quantile_bins_sql('score', 'scored')}
SELECT b AS bin, count(*) AS n, {q('avg(score)')} AS mean_predicted,
  {q('avg(label)')} AS fraction_positive FROM binned GROUP BY 1""", ("scored",))
def calibration_curve(t):
    return rounded(evaluate.calibration_curve(scored(t)))


@query("score_histogram", f"""
WITH r AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
b AS (SELECT label, greatest(1, least(50, floor((score - lo) / ((hi - lo) / 50)) + 1))::INTEGER
  AS bin, (hi - lo) / 50 AS w FROM scored, r)
SELECT label, bin, count(*) AS n,
  {q('count(*) / (sum(count(*)) OVER (PARTITION BY label) * any_value(w))')} AS density
FROM b GROUP BY 1, 2""", ("scored",))
def score_histogram(t):
    return rounded(evaluate.score_histogram(scored(t)))


@query("regression_metrics", f"""
WITH o AS (SELECT revenue / price AS y, 20 + "adFlag" * 10 AS p FROM interactions
  WHERE "order" = 1)
SELECT {q('avg(abs(y - p))')} AS mae, {q('sqrt(avg((y - p) ** 2))')} AS rmse,
  {q('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))')} AS r2 FROM o""", ("interactions",))
def regression_metrics(t):
    df = t.interactions.filter("order = 1").select(
        (F.col("revenue") / F.col("price")).alias("label"),
        (F.lit(20.0) + F.col("adFlag") * 10).alias("prediction"))
    return rounded(evaluate.regression_metrics(df))


# Metrics of two stored earlier experiments.
BASELINES = [
    {"experiment": "baseline_top_10", "roc_auc": 0.6945, "pr_auc": 0.4146, "f1": 0.4773},
    {"experiment": "baseline_all_numeric", "roc_auc": 0.7050, "pr_auc": 0.4285, "f1": 0.4852},
]


@query("compare_baselines", f"""
WITH {CURVE}, m AS (SELECT {q('sum(n * (cp - p / 2)) / (any_value(tp) * any_value(tn))')}
  AS roc_auc, {q('sum(p * cp / (cp + cn)) / sum(p)')} AS pr_auc FROM run),
f AS (SELECT {PRF} FROM ({at_sql(0.3, 'scored')}))
SELECT 'price_score' AS experiment, v.e AS baseline, m.roc_auc, m.pr_auc, f.f1,
  {q('m.roc_auc - v.a')} AS delta_roc_auc, {q('m.pr_auc - v.p')} AS delta_pr_auc,
  {q('f.f1 - v.f')} AS delta_f1
FROM m, f, (VALUES ('baseline_top_10', 0.6945, 0.4146, 0.4773),
  ('baseline_all_numeric', 0.7050, 0.4285, 0.4852)) v(e, a, p, f)""", ("scored",))
def compare_baselines(t):
    metrics = rounded(evaluate.binary_report(scored(t), 0.3)).withColumn(
        "experiment", F.lit("price_score"))
    return rounded(evaluate.compare_to_baselines(metrics, BASELINES,
                                                 ["roc_auc", "pr_auc", "f1"]))
