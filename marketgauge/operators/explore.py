"""Descriptive tables: profiles, funnels, daily series, price bins, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.bins import equal_width_bin, equal_width_edges, quantile_bin
from ..functions.features import (action_label, calendar, position_bucket, price_category,
                                  quantity, quantity_class, quantity_rounded)
from ..functions.numbers import ratio
from ..functions.text import classify_content
from ..session import checked_broadcast, cut
from ..sources.tables import long_form
from .cleaning import action_sum, log_ratio_band
from .ordered import exact_quantiles, quantile_values

# ---- missing values, keys, distinct values ----


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent; one pass."""
    total = F.count("*")
    row = df.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("missing"), total.alias("n"))
                   .alias(c) for c in df.columns])
    out = long_form(row, df.columns, value="v")
    return (out.select("column", F.col("v.missing").alias("missing"),
                       ratio(F.col("v.missing") * 100.0, F.col("v.n")).alias("missing_pct"))
            .filter(F.col("missing") > 0))


def row_missing(df: DataFrame) -> DataFrame:
    """Row-wise missing percent described; the values are at most columns + 1 many."""
    width = len(df.columns)
    gaps = sum((F.col(c).isNull().cast("int") for c in df.columns[1:]),
               F.col(df.columns[0]).isNull().cast("int"))
    pct = gaps * 100.0 / width
    quarts = [F.percentile(pct, F.lit(p)).alias(n)
              for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return df.agg(F.count("*").alias("rows"), F.avg(pct).alias("mean"),
                  F.stddev_samp(pct).alias("std"), F.min(pct).alias("min"), *quarts,
                  F.max(pct).alias("max"), F.count_if(gaps > 0).alias("rows_with_missing"))


def _as_told_apart(df: DataFrame, col: str) -> list[Column]:
    """What tells the values of a column apart as their text does, without writing it: the value
    itself, and the sign of a zero."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Only a zero is written as text.
        minus = F.when(F.col(col) == 0, F.col(col).cast("string").startswith("-"))
        return [F.col(col).alias("value"), minus.alias("minus")]
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.StringType, T.BooleanType, T.DateType)):
        return [F.col(col).alias("value")]
    return [F.col(col).cast("string").alias("value")]


def distinct_profile(df: DataFrame, cols: Sequence[str] | None = None,
                     approximate: float | None = None) -> DataFrame:
    """Distinct values per column. Exact: the rows are written once, and each column is reduced to
    its values by itself, as they are, spread over the cluster; `approximate` takes a relative error
    and needs no shuffle of values."""
    cols = list(cols or df.columns)
    if approximate is not None:
        row = df.agg(*[F.approx_count_distinct(c, approximate).alias(c) for c in cols])
        return long_form(row, cols, value="n_distinct")
    stored, out = cut(df.select(*cols)), None
    for c in cols:
        values = stored.select(*_as_told_apart(stored, c)).distinct()
        # A column of an empty table has no row.
        one = values.groupBy(F.lit(c).alias("column")).agg(F.count("value").alias("n_distinct"))
        out = one if out is None else out.unionByName(one)
    return out


def distinct_values(df: DataFrame, cols: Sequence[str], limit: int) -> DataFrame:
    """Sorted distinct values of the columns that have at most `limit` of them."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in cols]
    values = (df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull()).distinct())
    few = values.groupBy("column").count().filter(F.col("count") <= limit).select("column")
    # At most one row per column name.
    return values.join(F.broadcast(few), "column", "left_semi").orderBy("column", "value")


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """Rows, missing keys, distinct keys, surplus rows and uniqueness of a key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(known).alias("n_distinct"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        (F.count_if(~known | (F.col("n") > 1)) == 0).cast("int").alias("is_unique"))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Value, count and percent of the counted rows."""
    if dropna:
        df = df.filter(F.col(col).isNotNull())
    total = df.agg(F.count("*").alias("n")).scalar()
    return (df.groupBy(col).agg(F.count("*").alias("n"))
            .withColumn("pct", ratio(F.col("n") * 100.0, total)))


# ---- actions and funnels ----


def action_exclusivity(df: DataFrame) -> DataFrame:
    """How many rows have 0, 1, .. actions."""
    return df.groupBy(action_sum().alias("action_sum")).agg(F.count("*").alias("rows"))


def revenue_check(df: DataFrame) -> DataFrame:
    """Revenue min, max, mean, median per order flag."""
    med = exact_quantiles(df, ["revenue"], [0.5], by=["order"]).select(
        "order", F.col("quantiles")[0].alias("median"))
    stats = df.groupBy("order").agg(F.min("revenue").alias("min"), F.max("revenue").alias("max"),
                                    F.avg("revenue").alias("mean"))
    return stats.join(med, "order", "left")


def class_balance(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.struct(F.sum(c).alias("n"), F.avg(c).alias("share")).alias(c)
                   for c in schema.ACTIONS])
    return long_form(row, schema.ACTIONS, "action", "v").select(
        "action", F.col("v.n").alias("n"), F.col("v.share").alias("share"))


def funnel(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Browsed only, intent, purchase and intent-to-order percent; with `by`, impressions,
    action counts and rates per group."""
    click, basket, order = (F.sum(c) for c in schema.ACTIONS)
    rows = F.count("*")
    if by:
        return df.groupBy(*by).agg(
            rows.alias("impression"), click.alias("click"), basket.alias("basket"),
            order.alias("order"), ratio(click, rows).alias("click_rate"),
            ratio(basket, rows).alias("basket_rate"), ratio(order, rows).alias("order_rate"))
    return df.agg(
        ratio(click * 100.0, rows).alias("browsed_only_pct"),
        ratio((basket + order) * 100.0, rows).alias("intent_pct"),
        ratio(order * 100.0, rows).alias("purchase_pct"),
        ratio(order * 100.0, basket + order).alias("intent_to_order_pct"))


def event_funnel(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Events and share per step of a funnel over an event log."""
    total = events.agg(F.count("*").alias("n")).scalar()
    return (events.filter(F.col("event_type").isin(*steps)).groupBy("event_type")
            .agg(F.count("*").alias("n")).withColumn("share", ratio("n", total)))


# ---- numeric descriptions ----

QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per column."""
    row = df.agg(*[F.struct(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
        for c in cols])
    quarts = exact_quantiles(df, cols, QUARTILES)
    return (long_form(row, cols, value="v").join(quarts, "column", "left")
            .select("column", "v.count", "v.mean", "v.std", "v.min",
                    F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
                    F.col("quantiles")[2].alias("q3"), "v.max"))


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """describe_numeric plus missing count and the 1.5 IQR fences."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    spread = F.col("q3") - F.col("q1")
    return (describe_numeric(df, cols).join(long_form(row, cols, value="missing"), "column")
            .select("column", F.col("count").alias("n"), "missing", "min", "q1", "mean",
                    "median", "q3", "max",
                    (F.col("q1") - 1.5 * spread).alias("lower_fence"),
                    (F.col("q3") + 1.5 * spread).alias("upper_fence")))


def iqr_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values beyond the 1.5 IQR fences per column, count and percent."""
    rows = exact_quantiles(df, cols, [0.25, 0.75]).collect()
    fences = {}
    for r in rows:
        q1, q3 = r["quantiles"]
        fences[r["column"]] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    found = list(fences)
    row = df.agg(*[F.struct(
        F.lit(fences[c][0]).alias("lower"), F.lit(fences[c][1]).alias("upper"),
        F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1])).alias("n"),
        F.count(c).alias("all")).alias(c) for c in found])
    return long_form(row, found, value="v").select(
        "column", "v.lower", "v.upper", F.col("v.n").alias("outliers"),
        ratio(F.col("v.n") * 100.0, F.col("v.all")).alias("outlier_pct"))


def quantity_profile(df: DataFrame) -> DataFrame:
    """Units per order described; single-unit share; 99th percentile and rows above it."""
    q = (df.filter(F.col("order") == 1).select(quantity().alias("quantity"))
         .filter(F.col("quantity").isNotNull()))
    cap = quantile_values(q, "quantity", [0.99])[0]
    extra = q.agg(F.avg((F.col("quantity") == 1).cast("double")).alias("single_unit_share"),
                  F.lit(cap).alias("p99"),
                  F.count_if(F.col("quantity") > cap).alias("above_p99"))
    # Both sides are one row; the constant key avoids a cross join.
    one = F.lit("quantity").alias("column")
    return describe_numeric(q, ["quantity"]).join(extra.select(one, "*"), "column")


def quantity_class_counts(df: DataFrame) -> DataFrame:
    """Orders per quantity class in fixed order; a class without rows counts 0."""
    orders = df.filter(F.col("order") == 1).select(
        quantity_class(quantity_rounded()).alias("quantity_class"))
    row = orders.agg(
        *[F.count_if(F.col("quantity_class") == c).alias(c) for c in schema.QUANTITY_CLASSES],
        F.count("*").alias("total"))
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("quantity_class"),
                     F.col(f"`{c}`").alias("n"), F.col("total"))
            for i, c in enumerate(schema.QUANTITY_CLASSES)]
    return row.select(F.inline(F.array(*rows))).select(
        "position", "quantity_class", "n", ratio(F.col("n") * 100.0, F.col("total")).alias("pct"))


def price_sanity(df: DataFrame) -> DataFrame:
    """Zero and missing competitor prices, and whether any price is below 1."""
    return df.agg(F.count_if(F.col("competitorPrice") == 0).alias("competitor_zero"),
                  F.count_if(F.col("competitorPrice").isNull()).alias("competitor_missing"),
                  F.coalesce(F.bool_or(F.col("price") < 1), F.lit(False)).cast("int")
                  .alias("any_price_below_1"))


def skewness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness per column."""
    return long_form(df.agg(*[F.skewness(c).alias(c) for c in cols]), cols, value="skewness")


# ---- rates by group ----


def order_rate_by(df: DataFrame, col: str, null_label: str | None = None) -> DataFrame:
    """Order rate and rows per value; NULL is left out, or kept under `null_label`."""
    key = F.col(col)
    if null_label is None:
        df = df.filter(key.isNotNull())
    else:
        key = F.coalesce(key.cast("string"), F.lit(null_label))
    return df.groupBy(key.alias(col)).agg(F.count("*").alias("n"),
                                          F.avg("order").alias("order_rate"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The `n` most frequent values: interactions, order rate and share of all rows."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count("*").alias("interactions"), F.avg("order").alias("order_rate"))
            .orderBy(F.desc("interactions"), col).limit(n)
            .withColumn("coverage", ratio("interactions", total)))


def top_n(df: DataFrame, by: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """The `n` largest rows: a top-n per task, then one merge of n rows per task."""
    return df.orderBy(F.desc(by), *tiebreak).limit(n)


def group_sizes(df: DataFrame, col: str) -> DataFrame:
    """Rows and class counts per group value (sizes of the per-group subsets)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count("*").alias("n"), F.sum("order").alias("orders"),
                 F.count_if(F.col("order") == 0).alias("others")))


def segment_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, order rate, prices, gap and revenue per segment."""
    aggs = [F.count("*").alias("n"), F.avg("order").alias("order_rate"),
            F.avg("price").alias("avg_price"), F.avg("revenue").alias("avg_revenue")]
    if "price_pct_diff_competitor" in df.columns:
        aggs.append(F.avg("price_pct_diff_competitor").alias("avg_price_gap_pct"))
    return df.groupBy(*keys).agg(*aggs)


def category_sensitivity(df: DataFrame, key: str = "category", min_n: int = 1000) -> DataFrame:
    """Correlation of price gap and order per category with at least `min_n` rows."""
    both = F.col("price_pct_diff_competitor").isNotNull()
    r = F.corr(F.when(both, F.col("price_pct_diff_competitor")),
               F.when(both, F.col("order").cast("double")))
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count("*").alias("n"), F.avg("order").alias("order_rate"),
                 r.alias("corr_gap_vs_order"))
            .filter((F.col("n") >= min_n) & F.col("corr_gap_vs_order").isNotNull()
                    & ~F.isnan("corr_gap_vs_order")))


def best_worst(summary: DataFrame, label: str, score: str) -> DataFrame:
    """Label with the highest and the lowest score; ties by label."""
    return summary.filter(F.col(score).isNotNull()).agg(
        F.min_by(label, F.struct(-F.col(score), label)).alias("best"),
        F.max(score).alias("best_score"),
        F.min_by(label, F.struct(score, label)).alias("worst"),
        F.min(score).alias("worst_score"))


# ---- daily series ----


def daily_series(df: DataFrame) -> DataFrame:
    rows = F.count("*")
    return df.groupBy("day").agg(
        rows.alias("interactions"), F.sum("order").alias("orders"),
        ratio(F.sum("order") * 100.0, rows).alias("order_rate"),
        F.avg("click").alias("click_rate"), F.avg("basket").alias("basket_rate"),
        F.avg("price").alias("avg_price"), F.avg("competitorPrice").alias("avg_comp"))


def daily_extremes(daily: DataFrame, head: int = 10) -> DataFrame:
    """Days of highest and lowest volume and rate; mean volume of the first and last days."""
    ends = daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi")).alias("e"))
    lo, hi = ends.scalar().getField("lo"), ends.scalar().getField("hi")

    def at(score: Column) -> Column:
        return F.min_by("day", F.struct(score, F.col("day")))

    return daily.agg(
        at(-F.col("interactions")).alias("max_volume_day"),
        at(F.col("interactions")).alias("min_volume_day"),
        at(-F.col("order_rate")).alias("max_rate_day"),
        at(F.col("order_rate")).alias("min_rate_day"),
        F.avg(F.when(F.col("day") < lo + head, F.col("interactions"))).alias("first_days_avg"),
        F.avg(F.when(F.col("day") > hi - head, F.col("interactions"))).alias("last_days_avg"))


def detect_break(daily: DataFrame) -> DataFrame:
    """Day of the largest one-day fall of the order rate (the window holds one row a day)."""
    change = F.col("order_rate") - F.lag("order_rate").over(Window.orderBy("day"))
    return (daily.withColumn("change", change).filter(F.col("change").isNotNull())
            .agg(F.min_by("day", F.struct("change", "day")).alias("break_day"),
                 F.min("change").alias("rate_change")))


def regime_compare(daily: DataFrame, day: int | Column) -> DataFrame:
    """Mean volume and order rate before and from a day, with relative and point change."""
    cutoff = F.lit(day) if isinstance(day, int) else day
    before = F.col("day") < cutoff

    def mean(c: str, side: Column) -> Column:
        return F.avg(F.when(side, F.col(c)))

    v0, v1 = mean("interactions", before), mean("interactions", ~before)
    r0, r1 = mean("order_rate", before), mean("order_rate", ~before)
    return daily.agg(
        v0.alias("volume_before"), v1.alias("volume_after"), r0.alias("rate_before"),
        r1.alias("rate_after"), ((ratio(v1, v0) - 1) * 100).alias("volume_change_pct"),
        (r1 - r0).alias("rate_change_pp"))


def daily_price_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(
        F.avg("price").alias("avg_price"), F.avg("competitorPrice").alias("avg_comp"),
        F.avg("rrp").alias("avg_rrp"),
        F.avg(F.col("price") - F.col("rrp")).alias("avg_above_rrp_abs"),
        F.avg(ratio("price", "rrp") - 1).alias("avg_above_rrp_pct"),
        F.count("lineID").alias("n"))


def daily_gap(df: DataFrame) -> DataFrame:
    price, comp = F.avg("price"), F.avg("competitorPrice")
    return df.groupBy("day").agg(
        price.alias("avg_price"), comp.alias("avg_comp"), F.count("lineID").alias("n"),
        (F.avg(F.col("competitorPrice").isNull().cast("double")) * 100)
        .alias("comp_missing_rate"),
        (price - comp).alias("avg_gap"), ratio(price, comp).alias("avg_ratio"))


def daily_by_category(df: DataFrame, key: str = "price_cat") -> DataFrame:
    """Daily action rates and prices per price category (or another key), in one job."""
    if key == "price_cat":
        df = df.withColumn(key, price_category(F.col("price")))
    return df.groupBy(key, "day").agg(
        F.avg("click").alias("click_rate"), F.avg("basket").alias("basket_rate"),
        F.avg("order").alias("order_rate"), F.avg("price").alias("avg_price"),
        F.avg("competitorPrice").alias("avg_comp"), F.count("lineID").alias("n"))


def daily_cvr(df: DataFrame) -> DataFrame:
    """(day, cvr): orders per click of the day; NULL on a day without clicks."""
    return df.groupBy("day").agg(ratio(F.sum("order"), F.sum("click")).alias("daily_cvr"))


def daily_action_pivot(df: DataFrame) -> DataFrame:
    return (df.groupBy("day").pivot("action", schema.ACTIONS).count()
            .na.fill(0, schema.ACTIONS))


def seasonal_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orders per weekday, or per week and weekday."""
    orders = calendar(df.filter(F.col("order") == 1))
    counts = orders.groupBy(*keys).agg(F.count("*").alias("orders"))
    if list(keys) == ["weekday"]:
        axis = df.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
        return (axis.join(counts, "weekday", "left").na.fill(0, ["orders"]))
    return counts


def zero_filled_daily_orders(df: DataFrame) -> DataFrame:
    """Orders per day with the gaps between first and last day filled by 0."""
    daily = df.groupBy("day").agg(F.sum("order").alias("orders"))
    axis = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day"))
    return axis.join(daily, "day", "left").na.fill(0, ["orders"])


def autocorrelation(df: DataFrame, lags: int = 21) -> DataFrame:
    """Correlation of daily orders with themselves `lag` days before, for each lag."""
    series = checked_broadcast(zero_filled_daily_orders(df))
    shifted = series.select(F.col("orders").alias("before"), F.col("day").alias("_day"),
                            F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    pairs = (shifted.withColumn("day", F.col("_day") + F.col("lag"))
             .join(series, "day"))
    return pairs.groupBy("lag").agg(
        F.corr(F.col("orders").cast("double"), F.col("before").cast("double"))
        .alias("autocorrelation"))


# ---- price bins, curves, conflicts ----


def content_formats(items: DataFrame, samples: int = 3) -> DataFrame:
    """Content formats with count, percent and the first few distinct examples.

    The per-format rank has a small upper bound, so each task forwards only `samples` rows.
    """
    fmt = items.select(classify_content("content").alias("content_format"), "content")
    total = fmt.agg(F.count("*").alias("n")).scalar()
    counts = fmt.groupBy("content_format").agg(F.count("*").alias("n"))
    first = Window.partitionBy("content_format").orderBy("content")
    examples = (fmt.filter(F.col("content").isNotNull()).distinct()
                .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= samples)
                .groupBy("content_format")
                .agg(F.array_join(F.sort_array(F.collect_list("content")), ", ")
                     .alias("examples")))
    return (counts.join(examples, "content_format", "left")
            .withColumn("pct", ratio(F.col("n") * 100.0, total)))


def log_ratio_by_action(df: DataFrame) -> DataFrame:
    """Median and mean log price ratio and percent cheaper than the competitor, per action."""
    banded = log_ratio_band(df).withColumn("action", action_label())
    med = exact_quantiles(banded, ["log_price_ratio"], [0.5], by=["action"]).select(
        "action", F.col("quantiles")[0].alias("median_log_ratio"))
    stats = banded.groupBy("action").agg(
        F.count("*").alias("n"), F.avg("log_price_ratio").alias("mean_log_ratio"),
        (F.avg((F.col("log_price_ratio") < 0).cast("double")) * 100).alias("cheaper_pct"))
    return stats.join(med, "action")


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    return quantile_values(df, col, [i / q for i in range(q + 1)])


def decile_curve(df: DataFrame, q: int = 10, z: float = 1.96) -> DataFrame:
    """Order rate per price quantile bin with mean price, standard error and 95% interval."""
    data = df.select("price", "order").dropna().filter(F.col("price") > 0)
    decile = quantile_bin(F.col("price"), quantile_edges(data, "price", q))
    rate = F.avg("order")
    n = F.count("*")
    err = F.sqrt(rate * (1 - rate) / n)
    return data.groupBy(decile.alias("price_decile")).agg(
        n.alias("n"), F.avg("price").alias("mean_price"),
        (rate * 100).alias("order_rate_pct"), err.alias("standard_error"),
        ((rate + z * err) * 100).alias("ci_upper"), ((rate - z * err) * 100).alias("ci_lower"))


def conversion_drop(curve: DataFrame) -> DataFrame:
    """Relative fall of the order rate from the cheapest to the dearest bin, in percent."""
    first = F.min_by("order_rate_pct", "price_decile")
    last = F.max_by("order_rate_pct", "price_decile")
    return curve.agg(first.alias("first_rate_pct"), last.alias("last_rate_pct"),
                     (ratio(first - last, first) * 100).alias("conversion_drop_pct"))


def rates_by_bin(df: DataFrame, q: int = 10) -> DataFrame:
    """Click, basket and order rate per price quantile bin."""
    data = df.filter(F.col("price").isNotNull())
    bin_ = quantile_bin(F.col("price"), quantile_edges(data, "price", q))
    return data.groupBy(bin_.alias("price_bin")).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_rate") for c in schema.ACTIONS])


def equal_width_counts(df: DataFrame, col: str, n: int, right: bool = True) -> DataFrame:
    """Rows per equal-width bin of a column."""
    lo, hi = equal_width_edges(df, col)
    return (df.filter(F.col(col).isNotNull())
            .groupBy(equal_width_bin(F.col(col), lo, hi, n, right).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(col).alias("min"), F.max(col).alias("max")))


def histogram(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """Left-closed equal-width histogram of one or more columns over their common range,
    with the natural log of each count."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
             for c in cols]
    long = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    lo, hi = equal_width_edges(long, "value")
    return (long.groupBy("column", equal_width_bin(F.col("value"), lo, hi, bins, right=False)
                         .alias("bin"))
            .agg(F.count("*").alias("n")).withColumn("log_n", F.ln("n"))
            .withColumn("left_edge", F.lit(lo) + (F.col("bin") - 1) * F.lit((hi - lo) / bins)))


def impute_competitor_by_bin(df: DataFrame, n: int = 50) -> DataFrame:
    """Estimates a missing competitor price from the mean gap of its price bin.

    Bins without any known competitor price fall back on the overall median gap of the rows.
    """
    lo, hi = equal_width_edges(df, "price")
    binned = df.withColumn("price_bin", equal_width_bin(F.col("price"), lo, hi, n))
    known = binned.filter(F.col("competitorPrice").isNotNull())
    mean_price = F.avg("price")
    stats = known.groupBy("price_bin").agg(
        (ratio(F.avg("competitorPrice") - mean_price, mean_price) * 100).alias("pct_diff"))
    gap = known.select((ratio(F.col("competitorPrice") - F.col("price"), F.col("price")) * 100)
                       .alias("gap"))
    fallback = quantile_values(gap, "gap", [0.5])[0]
    # One row per bin: at most `n`.
    filled = (binned.filter(F.col("competitorPrice").isNull())
              .join(F.broadcast(stats), "price_bin", "left")
              .withColumn("pct_diff", F.coalesce("pct_diff", F.lit(fallback))))
    return filled.select("lineID", "pid", "day", "price", "price_bin", "pct_diff",
                         (F.col("price") + F.col("price") / 100 * F.col("pct_diff"))
                         .alias("estimated_competitor_price"))


def price_conflicts(df: DataFrame, only: bool = True) -> DataFrame:
    """(pid, day) pairs with the number of distinct prices, extremes, rows and spread.

    Two aggregations on nested keys: equal prices collapse before the pair is formed.
    """
    prices = df.groupBy("pid", "day", "price").agg(F.count("*").alias("n"))
    out = prices.groupBy("pid", "day").agg(
        F.count("price").alias("n_unique_prices"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.sum("n").alias("n_rows"))
    out = out.withColumn("price_diff", F.col("max_price") - F.col("min_price"))
    return out.filter(F.col("n_unique_prices") > 1) if only else out


def price_conflict_summary(df: DataFrame) -> DataFrame:
    pairs = price_conflicts(df, only=False)
    conflict = F.col("n_unique_prices") > 1
    per_pid = pairs.groupBy("pid").agg(F.count("*").alias("n"),
                                       F.count_if(conflict).alias("c"))
    return per_pid.agg(F.sum("n").alias("pairs"), F.sum("c").alias("conflicts"),
                       ratio(F.sum("c") * 100.0, F.sum("n")).alias("conflict_pct"),
                       F.count_if(F.col("c") > 0).alias("pids_affected"))


def worst_conflict_rows(df: DataFrame) -> DataFrame:
    """All rows of the (pid, day) pair with the largest spread."""
    worst = (price_conflicts(df).orderBy(F.desc("price_diff"), "pid", "day").limit(1)
             .select("pid", "day"))
    # One row by construction.
    return df.join(F.broadcast(worst), ["pid", "day"], "left_semi")


def bucket_summary(df: DataFrame) -> DataFrame:
    """Per price-position bucket: rows, order rate, mean prices, revenue and discount.
    Expects the gap as a fraction; buckets without rows are kept with n = 0."""
    binned = df.withColumn("bucket", position_bucket(F.col("price_pct_diff_competitor")))
    stats = binned.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("order").alias("order_rate"),
        F.avg("price").alias("avg_price"), F.avg("competitorPrice").alias("avg_competitor_price"),
        F.avg("revenue").alias("avg_revenue"),
        F.avg("discount_to_rrp_pct").alias("avg_discount_to_rrp_pct"))
    axis = df.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, schema.POSITION_LABELS))).alias("bucket"))
    return axis.join(stats, "bucket", "left").na.fill(0, ["n"])


def share_compare(a: DataFrame, b: DataFrame, col: str, names: tuple[str, str]) -> DataFrame:
    """Class shares of two tables side by side."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count("*").alias("n")).scalar()
        return df.groupBy(col).agg(ratio(F.count("*"), F.first(total)).alias(f"{name}_share"))

    return shares(a, names[0]).join(shares(b, names[1]), col, "full")
