"""Row-level features. Every function is a projection: no shuffle, no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from .bins import labelled_bin, left_closed_bin
from .numbers import flag, ratio, round_half_even, safe_ln


def null_nonpositive(df: DataFrame, col: str = "competitorPrice") -> DataFrame:
    """A price of 0 or less means no valid price."""
    return df.withColumn(col, F.when(F.col(col) > 0, F.col(col)))


def competitor_gap(df: DataFrame, scale: str = "percent") -> DataFrame:
    """Own price against the competitor's. "percent" rounds to 2, 4 and 2 digits;
    "fraction" recomputes ratio and relative gap unrounded on valid (> 0) prices."""
    price, comp = F.col("price"), F.col("competitorPrice")
    if scale == "fraction":
        valid = F.when(comp > 0, comp)
        return df.withColumns({
            "has_competitor": valid.isNotNull().cast("int"),
            "price_ratio_competitor": ratio(price, valid),
            "price_pct_diff_competitor": ratio(price - valid, valid),
        })
    return df.withColumns({
        "price_diff_competitor": round_half_even(price - comp, 2),
        "price_ratio_competitor": round_half_even(ratio(price, comp), 4),
        "price_pct_diff_competitor": round_half_even(ratio(price - comp, comp) * 100, 2),
    })


def post_shift(df: DataFrame, shift_day: int = schema.SHIFT_DAY) -> DataFrame:
    return df.withColumn("is_post_shift_day", (F.col("day") >= shift_day).cast("int"))


def one_hot_fixed(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed level, present even if unused; the source is dropped."""
    hot = {f"{col}_{v}": flag(F.col(col) == v) for v in levels}
    return df.withColumns(hot).drop(col)


def rrp_position(df: DataFrame) -> DataFrame:
    rrp = F.when(F.col("rrp") > 0, F.col("rrp"))
    return df.withColumns({
        "price_to_rrp_ratio": ratio(F.col("price"), rrp),
        "discount_to_rrp_pct": ratio(rrp - F.col("price"), rrp),
    })


def above_rrp(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "above_rrp_abs": F.col("price") - F.col("rrp"),
        "above_rrp_pct": ratio("price", "rrp") - 1,
    })


def log_prices(df: DataFrame) -> DataFrame:
    valid = F.when(F.col("competitorPrice") > 0, F.col("competitorPrice"))
    return df.withColumns({
        "log_price": safe_ln("price"),
        "log_price_ratio": F.ln(ratio(F.col("price"), valid)),
    })


def pack_economics(df: DataFrame) -> DataFrame:
    """Prices per content unit and their ratios; content 0 gives NULL."""
    units = F.nullif(F.col("content"), F.lit(0.0))
    return (df
            .withColumns({
                "unit_price": ratio(F.col("price"), units),
                "unit_rrp": ratio(F.col("rrp"), units),
                "unit_competitor_price": ratio(F.col("competitorPrice"), units),
            })
            .withColumns({
                "unit_price_to_rrp_ratio": ratio("unit_price", "unit_rrp"),
                "unit_price_to_comp_ratio": ratio("unit_price", "unit_competitor_price"),
            }))


def price_flags(df: DataFrame) -> DataFrame:
    """Cheaper / dearer than a valid competitor price; undercutting compares as is."""
    price, comp = F.col("price"), F.col("competitorPrice")
    return df.withColumns({
        "is_cheaper_than_comp": flag((comp > 0) & (price < comp)),
        "is_more_expensive_than_comp": flag((comp > 0) & (price > comp)),
        "is_undercutting_competitor": flag(price < comp),
    })


def abs_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("abs_price_pct_diff_competitor", F.abs("price_pct_diff_competitor"))


def weekday(day: Column, base: int = 1, first: int = 1) -> Column:
    """Day of the week; `base` is the first day of the first week, `first` the first label."""
    return F.pmod(day - base, F.lit(7)) + first


def period_index(day: Column, length: int, base: int = 1, first: int = 1) -> Column:
    """Index of the `length`-day period a day falls in."""
    return (F.floor((day - base) / F.lit(length)) + first).cast("int")


def calendar(df: DataFrame, base: int = 1, first: int = 1) -> DataFrame:
    """weekday, 7-day week index and 30-day month index."""
    day = F.col("day")
    return df.withColumns({
        "weekday": weekday(day, base, first),
        "week_idx": period_index(day, 7, base, first),
        "month_idx": period_index(day, 30, base, first),
    })


def quantity() -> Column:
    """Units sold as revenue over price, unrounded."""
    return ratio("revenue", "price")


def quantity_rounded() -> Column:
    return F.rint(quantity()).cast("int")


def quantity_class(q: Column) -> Column:
    return (F.when(q <= 3, q.cast("string"))
            .when(q <= 5, "4-5")
            .when(q.isNotNull(), "6+"))


def price_category(c: Column) -> Column:
    """Fixed left-closed price ranges 1..6."""
    return left_closed_bin(c, schema.PRICE_CATEGORY_EDGES)


def position_bucket(c: Column) -> Column:
    """Seven named ranges of the relative price gap, given as a fraction."""
    return labelled_bin(c, schema.POSITION_EDGES, schema.POSITION_LABELS)


def price_interactions(df: DataFrame) -> DataFrame:
    """Price position times shop context: ad x discount, gap x availability."""
    return df.withColumns({
        "ad_x_discount": F.col("adFlag") * F.col("discount_to_rrp_pct"),
        "gap_x_availability": F.col("price_diff_competitor") * F.col("availability"),
    })


def action_label() -> Column:
    """Name of the first flag that is set, in the order click, basket, order."""
    first, *rest = schema.ACTIONS
    label = F.when(F.col(first) == 1, first)
    for name in rest:
        label = label.when(F.col(name) == 1, name)
    return label.otherwise("unknown")
