"""Correlations, association and feature screening."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import quantile_bin
from .ordered import exact_quantiles


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) per pair in one pass: the pairs of a row become rows of one small group key,
    combined before the shuffle."""
    def number(c: str):
        return F.col(c).cast("double")

    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    values = [F.struct(F.lit(i).alias("i"), number(a).alias("x"), number(b).alias("y"))
              for i, (a, b) in enumerate(pairs)]
    r = (df.select(F.inline(F.array(*values))).groupBy("i")
         .agg(F.corr("x", "y").alias("r")))
    return (F.broadcast(names).join(r, "i", "left")
            .select("a", "b", F.nanvl(F.col("r"), F.lit(None).cast("double")).alias("r")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) for all ordered pairs, each over the rows where both are present; one pass."""
    upper = _pair_rows(df, list(combinations(cols, 2)))
    mirrored = upper.select(F.inline(F.array(
        F.struct("a", "b", "r"),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")))))
    diagonal = df.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, cols))).alias("a")).select("a", F.col("a").alias("b"),
                                                                F.lit(1.0).alias("r"))
    return mirrored.unionByName(diagonal)


def corr_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of each column with the target, strongest positive first."""
    return (_pair_rows(df, [(c, target) for c in cols])
            .select(F.col("a").alias("column"), "r").orderBy(F.desc_nulls_last("r"), "column"))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Column pairs with |r| above the threshold, strongest first."""
    pairs = _pair_rows(df, list(combinations(cols, 2))).withColumn("abs_r", F.abs("r"))
    return pairs.filter(F.col("abs_r") > threshold).orderBy(F.desc("abs_r"), "a", "b")


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi-square, rows and Cramer's V of two categorical columns (NULLs left out). The
    continuity correction applies to 2 x 2 tables only.

    Empty cells need no grid: the statistic is n (sum of o^2 / (row total x column total) - 1).
    """
    cells = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(a, b).agg(F.count("*").alias("o")))
    cells = cells.withColumns({"ra": F.sum("o").over(Window.partitionBy(a)),
                               "cb": F.sum("o").over(Window.partitionBy(b))})
    o, ra, cb = (F.col(c).cast("double") for c in ("o", "ra", "cb"))
    n = F.sum("o").cast("double")
    rows, cols = F.count_distinct(a), F.count_distinct(b)
    plain = n * (F.sum(o * o / (ra * cb)) - 1)
    # In a 2 x 2 table |observed - expected| is the same in all four cells.
    stats = cells.agg(n.alias("n"), rows.alias("k"), cols.alias("m"), plain.alias("plain"),
                      F.first("o").alias("o"), F.first("ra").alias("ra"),
                      F.first("cb").alias("cb"))
    gap = F.abs(F.col("o") - F.col("ra") * F.col("cb") / F.col("n"))
    cut = gap - F.least(F.lit(0.5), gap)
    inverse = (F.col("n") * (1 / F.col("ra") + 1 / (F.col("n") - F.col("ra")))
               * (1 / F.col("cb") + 1 / (F.col("n") - F.col("cb"))))
    two_by_two = (F.col("k") == 2) & (F.col("m") == 2) & F.lit(yates)
    chi2 = F.when(two_by_two, cut * cut * inverse).otherwise(F.col("plain"))
    side = F.least("k", "m") - 1
    return stats.select(chi2.alias("chi2"), F.col("n").cast("long").alias("n"),
                        F.sqrt(F.try_divide(chi2, F.col("n") * side)).alias("cramers_v"))


def mutual_information(df: DataFrame, label: str, discrete: Sequence[str],
                       continuous: Sequence[str] = (), bins: int = 10,
                       top: int | None = None) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with a label, ranked.

    Continuous features are cut into quantile bins first; NULL is a value of its own. This is
    the binned estimator, not a nearest-neighbour one.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in discrete]
    if continuous:
        probs = [i / bins for i in range(bins + 1)]
        edges = {r["column"]: r["quantiles"]
                 for r in exact_quantiles(df, continuous, probs).collect()}
        pairs += [F.struct(F.lit(c).alias("column"),
                           quantile_bin(F.col(c), edges[c]).cast("string").alias("value"))
                  for c in continuous if c in edges]
    cells = (df.select(F.col(label).alias("y"), F.inline(F.array(*pairs)))
             .groupBy("column", "value", "y").agg(F.count("*").alias("nxy")))
    per_value = Window.partitionBy("column", "value")
    labels = cells.groupBy("column", "y").agg(F.sum("nxy").alias("ny"))
    labels = labels.withColumn("n", F.sum("ny").over(Window.partitionBy("column")))
    # One row per (column, label value).
    joined = (cells.withColumn("nx", F.sum("nxy").over(per_value))
              .join(F.broadcast(labels), ["column", "y"]))
    share = F.col("nxy") / F.col("n")
    gain = share * F.ln(F.col("nxy") * F.col("n").cast("double")
                        / (F.col("nx") * F.col("ny").cast("double")))
    scores = joined.groupBy("column").agg(F.sum(gain).alias("mi"))
    ranked = scores.orderBy(F.desc("mi"), "column")
    return ranked if top is None else ranked.limit(top)


def zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns whose values never differ."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double")
                            .alias("hi")).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}.lo").alias("lo"),
                      F.col(f"{c}.hi").alias("hi")) for c in cols]
    return (row.select(F.inline(F.array(*pairs)))
            .filter(F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).select("column"))


def price_elasticity(df: DataFrame) -> DataFrame:
    """Logit of order on ln(price): coefficient, p-value, and the elasticity
    coefficient x mean price x (1 - order rate)."""
    data = (df.select("price", F.col("order").cast("double").alias("label")).dropna()
            .filter(F.col("price") > 0).withColumn("log_price", F.ln("price")))
    frame = RFormula(formula="label ~ log_price").fit(data).transform(data)
    model = GeneralizedLinearRegression(family="binomial", link="logit").fit(frame)
    coefficient = float(model.coefficients[0])
    # p-values come as coefficients first, intercept last.
    p_value = float(model.summary.pValues[0])
    return data.agg(
        F.lit(coefficient).alias("coefficient"), F.lit(p_value).alias("p_value"),
        (F.lit(coefficient) * F.avg("price") * (1 - F.avg("label"))).alias("elasticity"))

