"""Filters, fills and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.features import action_label
from ..sources.tables import require_columns
from .joins import lookup
from .ordered import exact_quantiles


def fill_sentinels(df: DataFrame, sentinels: Mapping[str, str]) -> DataFrame:
    """Casts each column to string and replaces NULL by its sentinel."""
    require_columns(df, list(sentinels))
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v))
                           for c, v in sentinels.items()})


def flag_and_fill(df: DataFrame, col: str, value: float) -> DataFrame:
    """`<col>_missing` indicator, then a neutral value for the missing ones."""
    return df.withColumns({f"{col}_missing": F.col(col).isNull().cast("int"),
                           col: F.coalesce(F.col(col), F.lit(value))})


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column (a fitting step: one number per column)."""
    rows = exact_quantiles(df, cols, [0.5]).collect()
    return {r["column"]: r["quantiles"][0] for r in rows}


def fill_values(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v))
                           for c, v in values.items()})


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                  ) -> DataFrame:
    """Fills missing numbers with the exact median of `fit_on` (default: the table itself)."""
    return fill_values(df, medians(df if fit_on is None else fit_on, cols))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column; the smallest value wins a tie."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in cols]
    counts = (df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count("*").alias("n")))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def impute_mode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    found = modes(df if fit_on is None else fit_on, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v))
                           for c, v in found.items()})


def drop_leakage(df: DataFrame, policy: str) -> DataFrame:
    """Drops identifiers and outcome columns a model of this kind must not see."""
    return df.drop(*schema.LEAKAGE[policy])


def period_filter(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """lo <= day <= hi; prunes day folders of a partitioned table."""
    if lo is not None:
        df = df.filter(F.col("day") >= lo)
    return df if hi is None else df.filter(F.col("day") <= hi)


def orders_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("order") == 1)


def log_ratio_band(df: DataFrame, width: float = 1.0) -> DataFrame:
    """Rows with a valid competitor price and |ln(price / competitor)| below `width`."""
    valid = F.when(F.col("competitorPrice") > 0, F.col("competitorPrice"))
    log_ratio = F.ln(F.try_divide(F.col("price"), valid))
    return (df.withColumn("log_price_ratio", log_ratio)
            .filter((F.col("log_price_ratio") > -width) & (F.col("log_price_ratio") < width)))


def action_sum() -> Column:
    return sum((F.col(c) for c in schema.ACTIONS[1:]), F.col(schema.ACTIONS[0]))


def valid_actions(df: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Rows with exactly one action, labelled. on_bad="raise" shows up to 10 other rows."""
    one = F.coalesce(action_sum() == 1, F.lit(False))
    if on_bad == "raise":
        bad = df.filter(~one).select("lineID", "day", "pid", *schema.ACTIONS).limit(10).collect()
        if bad:
            raise ValueError(f"rows without exactly one action, for example {bad}")
    return df.filter(one).withColumn("action", action_label())


def null_unseen(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Category values that never occur in `train` become NULL."""
    out = df
    for c in cols:
        seen = (train.select(c).filter(F.col(c).isNotNull()).distinct()
                .withColumn("_seen", F.lit(True)))
        out = (lookup(out, seen, [c])
               .withColumn(c, F.when(F.col("_seen"), F.col(c))).drop("_seen"))
    return out.select(*df.columns)


def require_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Raises when a value is missing or outside [lo, hi]; returns the table unchanged."""
    bad = df.filter(F.col(col).isNull() | (F.col(col) < lo) | (F.col(col) > hi)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{col} must be within [{lo}, {hi}]: {bad.first()}")
    return df
