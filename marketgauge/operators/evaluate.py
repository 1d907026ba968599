"""Evaluation of scored rows: columns `label` (0/1) and `score`.

A row without a score is never flagged and ranks below all others; no metric leaves it out.

Curves work on one row per distinct score and range-partitioned running totals, so neither the
rows nor the distinct scores pass through one task. `by` evaluates many models or folds at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.bins import equal_width_bin, equal_width_edges, quantile_bin
from ..functions.numbers import ratio, round_half_even
from .ordered import quantile_values, running_totals


def _ranked() -> Column:
    return F.coalesce(F.col("score").cast("double"), F.lit(-float("inf")))


def score_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., score, pos, neg, cum_pos, cum_neg), totals over scores >= the row's score. Rows
    without a score stand at minus infinity."""
    counts = (df.groupBy(*by, _ranked().alias("score"))
              .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    return running_totals(counts, by, ["score"], ["pos", "neg"], descending=True)


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a random positive outranks a random negative; ties count half."""
    above = F.col("cum_pos").cast("double") - F.col("pos") / 2
    return score_curve(df, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("neg") * above),
                     F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision x recall step over the distinct scores."""
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return score_curve(df, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"))


def ranking_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision from one curve."""
    above = F.col("cum_pos").cast("double") - F.col("pos") / 2
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return score_curve(df, by).groupBy(*by).agg(
        F.try_divide(F.sum(F.col("neg") * above),
                     F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"))


def roc_points(df: DataFrame) -> DataFrame:
    """One row per distinct score: false and true positive rate of `score >= threshold`."""
    total = df.agg(F.struct(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
                   .alias("t")).scalar()
    return score_curve(df).select(
        F.col("score").alias("threshold"), ratio(F.col("cum_neg"), total.getField("n")).alias("fpr"),
        ratio(F.col("cum_pos"), total.getField("p")).alias("tpr"))


def pr_points(df: DataFrame) -> DataFrame:
    """One row per distinct score: precision and recall, with the no-skill precision."""
    total = df.agg(F.struct(F.sum("label").alias("p"), F.count("*").alias("n")).alias("t"))
    p, n = total.scalar().getField("p"), total.scalar().getField("n")
    return score_curve(df).select(
        F.col("score").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), p).alias("recall"), ratio(p, n).alias("no_skill"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; a zero denominator gives 0."""
    return (_or_zero(ratio(tp, tp + fp)), _or_zero(ratio(tp, tp + fn)),
            _or_zero(ratio(2 * tp, 2 * tp + fp + fn)))


def binary_metrics(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, error, precision, recall and F1 of `score >= threshold`."""
    hit, pos = _ranked() >= threshold, F.col("label") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, f1 = _prf(tp, fp, fn)
    right = ratio(tp + tn, tp + fp + fn + tn)
    return counts.select(*by, "tp", "fp", "fn", "tn", right.alias("accuracy"),
                         (1 - right).alias("error"), precision.alias("precision"),
                         recall.alias("recall"), f1.alias("f1"))


def binary_report(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Threshold metrics and ranking metrics side by side, one row per group."""
    at = binary_metrics(df, threshold, by)
    ranked = ranking_metrics(df, by)
    if by:
        return at.join(ranked, list(by))
    one = F.lit(0).alias("_one")
    return at.select("*", one).join(ranked.select("*", one), "_one").drop("_one")


def confusion(df: DataFrame, labels: Sequence[str], label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """All (label, prediction) cells in the given order: count and share of the label's rows."""
    grid = df.agg(*[F.count_if((F.col(label).cast("string") == a)
                               & (F.col(prediction).cast("string") == b)).alias(f"c{i}_{j}")
                    for i, a in enumerate(labels) for j, b in enumerate(labels)])
    cells = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                      F.col(f"c{i}_{j}").alias("n"),
                      ratio(F.col(f"c{i}_{j}"), sum((F.col(f"c{i}_{k}") for k in
                                                     range(1, len(labels))), F.col(f"c{i}_0")))
                      .alias("share"))
             for i, a in enumerate(labels) for j, b in enumerate(labels)]
    return grid.select(F.inline(F.array(*cells)))


def class_report(df: DataFrame, labels: Sequence[str], label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion cells."""
    cells = confusion(df, labels, label, prediction)
    per = cells.select(F.explode(F.array(*map(F.lit, labels))).alias("class"), "*")
    a, b, n = F.col("label") == F.col("class"), F.col("prediction") == F.col("class"), F.col("n")
    zero = F.lit(0).cast("long")
    counts = per.groupBy("class").agg(
        F.sum(F.when(a & b, n).otherwise(zero)).alias("tp"),
        F.sum(F.when(~a & b, n).otherwise(zero)).alias("fp"),
        F.sum(F.when(a & ~b, n).otherwise(zero)).alias("fn"))
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("class", precision.alias("precision"), recall.alias("recall"),
                         f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def multiclass_metrics(df: DataFrame, labels: Sequence[str], label: str = "label",
                       prediction: str = "prediction",
                       probabilities: Mapping[str, str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1, and log loss when `probabilities`
    names the column of each class."""
    report = class_report(df, labels, label, prediction)
    out = report.agg(
        ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    if probabilities is None:
        return out
    chosen = F.lit(None).cast("double")
    for c in labels:
        chosen = F.when(F.col(label).cast("string") == c, F.col(probabilities[c])).otherwise(chosen)
    eps = 1e-15
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), chosen))
    loss = df.agg((-F.avg(F.ln(clipped))).alias("l")).scalar()
    return out.withColumn("log_loss", loss)


# The threshold grids in use.
def sweep_grid(start: float = 0.05, stop: float = 0.95, step: float = 0.01) -> list[float]:
    count = round((stop - start) / step)
    return [start + i * step for i in range(count)]


def threshold_sweep(df: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of `score >= threshold` for every grid value.

    One aggregation: a score falls in the cell of the last threshold it reaches, and the counts
    of a threshold are the cells at or above it (grid size + 1 rows per group).
    """
    cells = Bucketizer(splits=[-float("inf"), *grid, float("inf")], inputCol="score",
                       outputCol="_cell").transform(df.withColumn("score", _ranked()))
    counts = cells.groupBy(*by, "_cell").agg(F.sum("label").alias("pos"),
                                             F.sum(1 - F.col("label")).alias("neg"))
    steps = [F.struct(F.lit(float(i)).alias("_cell"), F.lit(t).alias("threshold"))
             for i, t in enumerate([-float("inf"), *grid])]
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"))
    axis = totals.select(*by, "p", F.inline(F.array(*steps)))
    full = axis.join(counts, [*by, "_cell"], "left").na.fill(0, ["pos", "neg"])
    down = (Window.partitionBy(*by).orderBy(F.desc("_cell"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    swept = full.select(*by, "_cell", "threshold", "p", tp.alias("tp"), fp.alias("fp"))
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"))
    return (swept.filter(F.col("_cell") > 0)
            .select(*by, "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"),
                    precision.alias("precision"), recall.alias("recall"), f1.alias("f1")))


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Grid row with the highest F1; then precision, recall, and the lowest threshold."""
    order = F.struct(-F.col("f1"), -F.col("precision"), -F.col("recall"), F.col("threshold"))
    best = F.min_by(F.struct("threshold", "precision", "recall", "f1"), order)
    return sweep.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def average_over_folds(sweep: DataFrame) -> DataFrame:
    """F1 per threshold averaged over the folds of a sweep grouped by fold."""
    return sweep.groupBy("threshold").agg(F.avg("f1").alias("mean_f1"),
                                          F.stddev_pop("f1").alias("std_f1"))


def choose_threshold(means: DataFrame) -> DataFrame:
    """The threshold with the best averaged F1 (ties: the lowest)."""
    # Means that differ in the last bits only are ties.
    rounded = means.withColumn("mean_f1", round_half_even("mean_f1", 9))
    order = F.struct(-F.col("mean_f1"), F.col("threshold"))
    best = F.min_by(F.struct("threshold", "mean_f1", "std_f1"), order)
    return rounded.agg(best.alias("best")).select("best.*")


def tune_threshold_cv(df: DataFrame, fold: str, grid: Sequence[float]) -> DataFrame:
    """The threshold with the best F1 averaged over folds."""
    return choose_threshold(average_over_folds(threshold_sweep(df, grid, [fold])))


def nearest(sweep: DataFrame, points: Sequence[float]) -> DataFrame:
    """The grid row closest to each point (ties: the lower threshold)."""
    picks = [F.min_by(F.struct("threshold", "precision", "recall", "f1"),
                      F.struct(F.abs(F.col("threshold") - p), F.col("threshold"))).alias(f"p{i}")
             for i, p in enumerate(points)]
    rows = [F.struct(F.lit(p).alias("point"), F.col(f"p{i}").alias("v"))
            for i, p in enumerate(points)]
    return sweep.agg(*picks).select(F.inline(F.array(*rows))).select("point", "v.*")


def operating_points(df: DataFrame, points: Sequence[tuple[str, float]] = tuple(
        schema.OPERATING_POINTS)) -> DataFrame:
    """Flagged percent, TP, FN, FP, precision, recall and F1 for named thresholds; one pass."""
    pos = F.col("label") == 1
    counts = df.agg(F.count("*").alias("n"), F.count_if(pos).alias("p"), *[
        c for i, (_, t) in enumerate(points)
        for c in (F.count_if((F.col("score") >= t) & pos).alias(f"tp{i}"),
                  F.count_if((F.col("score") >= t) & ~pos).alias(f"fp{i}"))])
    rows = [F.struct(F.lit(name).alias("operating_point"), F.lit(t).alias("threshold"),
                     F.col(f"tp{i}").alias("tp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"),
                     F.col(f"fp{i}").alias("fp"), F.col("n").alias("n"))
            for i, (name, t) in enumerate(points)]
    flat = counts.select(F.inline(F.array(*rows)))
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return flat.select("operating_point", "threshold",
                       ratio((F.col("tp") + F.col("fp")) * 100.0, F.col("n")).alias("flagged_pct"),
                       "tp", "fn", "fp", precision.alias("precision"), recall.alias("recall"),
                       f1.alias("f1"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives per score quantile bin."""
    edges = quantile_values(df, "score", [i / bins for i in range(bins + 1)])
    return df.groupBy(quantile_bin(F.col("score"), edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_predicted"),
        F.avg("label").alias("fraction_positive"))


def score_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Density of the scores per label over a common equal-width grid."""
    lo, hi = equal_width_edges(df, "score")
    width = (hi - lo) / bins
    counts = df.groupBy("label", equal_width_bin(F.col("score"), lo, hi, bins, right=False)
                        .alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("label"))
    return counts.withColumn("density", ratio(F.col("n"), total * width))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       ) -> DataFrame:
    """MAE, RMSE and R2."""
    err = F.col(label) - F.col(prediction)
    sse = F.sum(err * err)
    sst = F.var_pop(label) * F.count(label)
    return df.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                  (1 - ratio(sse, sst)).alias("r2"))


def compare_to_baselines(metrics: DataFrame, baselines: Sequence[Mapping[str, object]],
                         names: Sequence[str]) -> DataFrame:
    """Every metric row against every stored baseline, with the differences."""
    stored = F.array(*[F.struct(F.lit(b["experiment"]).alias("baseline"),
                                *[F.lit(b[c]).alias(f"base_{c}") for c in names])
                       for b in baselines])
    return metrics.select("experiment", *names, F.inline(stored)).select(
        "experiment", "baseline", *names,
        *[(F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in names])


def gap_report(df: DataFrame, threshold: float) -> DataFrame:
    """Train and test error at a threshold and their gap; expects a `split` column."""
    errors = binary_metrics(df, threshold, ["split"])
    train = F.max(F.when(F.col("split") == "train", F.col("error")))
    test = F.max(F.when(F.col("split") == "test", F.col("error")))
    return errors.agg(train.alias("train_error"), test.alias("test_error"),
                      (test - train).alias("gap"))
