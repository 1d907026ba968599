"""Strictly-past history: a row of day D only ever sees days before D.

Every feature first collapses the facts to one row per (key, day), with map-side combine, so
a window partition holds at most one row per calendar day however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..session import cut
from .joins import attach


def first_price() -> Column:
    """Aggregate: the price of the smallest (lineID, price), prices told apart to four decimals.

    Both are put into one number: unlike a pair it fits a hash aggregate, which needs no sort of
    the facts.
    """
    line = F.col("lineID").cast("decimal(19,0)") * F.lit(10 ** 14).cast("decimal(15,0)")
    cents = F.round(F.col("price") * 10_000).cast("decimal(14,0)")
    return F.min_by("price", line + F.coalesce(cents, F.lit(0)))


def by_day(df: DataFrame, key: str) -> DataFrame:
    """(key, day) totals; rows without a key have no history."""
    return (df.filter(F.col(key).isNotNull())
            .groupBy(key, "day")
            .agg(F.count("*").alias("interactions"),
                 F.sum("order").alias("orders"),
                 F.sum("click").alias("clicks"),
                 F.sum("price").alias("price_sum"),
                 first_price().alias("first_price")))


def _days(key: str):
    return Window.partitionBy(key).orderBy("day")


def price_diff_prev_day(df: DataFrame) -> DataFrame:
    """(pid, day) with the change of the day's first price against the previous day the
    product was seen. First = smallest (lineID, price)."""
    daily = (df.groupBy("pid", "day")
             .agg(first_price().alias("first_price")))
    change = F.col("first_price") - F.lag("first_price").over(_days("pid"))
    return daily.select("pid", "day", change.alias("price_diff_vs_previous_available_day"))


def expanding_history(df: DataFrame, key: str) -> DataFrame:
    """Conversion, average price and row count of a key over all days before."""
    past = _days(key).rowsBetween(Window.unboundedPreceding, -1)
    orders, n, price = (F.sum(c).over(past) for c in ("orders", "interactions", "price_sum"))
    return by_day(df, key).select(
        key, "day",
        ratio(orders, n).alias(f"historical_conversion_{key}"),
        ratio(price, n).alias(f"historical_avg_price_{key}"),
        F.coalesce(n, F.lit(0)).alias(f"n_prior_appearances_{key}"))


def expanding_cvr(df: DataFrame, key: str) -> DataFrame:
    """Orders per click of a key over all days before."""
    past = _days(key).rowsBetween(Window.unboundedPreceding, -1)
    return by_day(df, key).select(
        key, "day", ratio(F.sum("orders").over(past), F.sum("clicks").over(past))
        .alias(f"expanding_cvr_{key}"))


def prev_day(df: DataFrame, key: str) -> DataFrame:
    """Orders, interactions and order rate of the previous observed day."""
    w = _days(key)
    orders, n = F.lag("orders").over(w), F.lag("interactions").over(w)
    return by_day(df, key).select(
        key, "day", orders.alias(f"{key}_prev_day_orders"),
        n.alias(f"{key}_prev_day_interactions"),
        ratio(orders, n).alias(f"{key}_prev_day_order_rate"))


def rolling_history(df: DataFrame, key: str, n: int) -> DataFrame:
    """Orders, interactions and order rate of the previous `n` observed days."""
    frame = _days(key).rowsBetween(-n, -1)
    orders, rows = F.sum("orders").over(frame), F.sum("interactions").over(frame)
    rate = ratio(orders, rows)
    return by_day(df, key).select(
        key, "day", orders.alias(f"{key}_prev_{n}d_orders"),
        rows.alias(f"{key}_prev_{n}d_interactions"),
        rate.alias(f"{key}_prev_{n}d_order_rate"),
        rate.isNotNull().cast("int").alias(f"has_{key}_history"))


def price_change_pct(df: DataFrame, key: str = "pid", first_price: bool = False) -> DataFrame:
    """Relative change of the daily mean (or first) price against the previous observed day."""
    daily = by_day(df, key).withColumn(
        "_price", F.col("first_price") if first_price else ratio("price_sum", "interactions"))
    before = F.lag("_price").over(_days(key))
    return daily.select(key, "day", before.alias(f"{key}_prev_price"),
                        ratio(F.col("_price") - before, before).alias(f"{key}_price_change_pct"))


def pid_history(df: DataFrame) -> DataFrame:
    """All product-level past-day features in one (pid, day) aggregate and one window sort."""
    w = _days("pid")
    daily = by_day(df, "pid").withColumn("_price", ratio("price_sum", "interactions"))

    def over(frame):
        orders, rows = F.sum("orders").over(frame), F.sum("interactions").over(frame)
        return ratio(orders, rows), rows

    rate3, _ = over(w.rowsBetween(-3, -1))
    rate7, rows7 = over(w.rowsBetween(-7, -1))
    before = F.lag("_price").over(w)
    rate1 = ratio(F.lag("orders").over(w), F.lag("interactions").over(w))
    return daily.select(
        "pid", "day", rate1.alias("pid_prev_day_order_rate"),
        rate3.alias("pid_prev_3d_order_rate"), rate7.alias("pid_prev_7d_order_rate"),
        rows7.alias("pid_prev_7d_interactions"),
        ratio(F.col("_price") - before, before).alias("pid_price_change_pct"))


def add_history(df: DataFrame) -> DataFrame:
    """Product and category past-day features on every row, with history-available flags. The
    rows are written once: they are read for each history and each count of its keys."""
    df = cut(df)
    category = (rolling_history(df, "category", 7)
                .select("category", "day", "category_prev_7d_order_rate"))
    out = attach(df, pid_history(df), ["pid", "day"], facts=df)
    out = attach(out, category, ["category", "day"], facts=df)
    return out.withColumns({
        "has_pid_history": F.col("pid_prev_day_order_rate").isNotNull().cast("int"),
        "has_category_history": F.col("category_prev_7d_order_rate").isNotNull().cast("int"),
    })


def add_expanding_history(df: DataFrame, keys: Sequence[str] = ("pid", "manufacturer", "group"),
                          ) -> DataFrame:
    """Expanding history of each key on every row, and price against the product's average. The
    rows are written once."""
    df = out = cut(df)
    for key in keys:
        out = attach(out, expanding_history(df, key), [key, "day"], facts=df)
    if "pid" in keys:
        out = out.withColumn("price_vs_hist_avg_pid", ratio("price", "historical_avg_price_pid"))
    return out
