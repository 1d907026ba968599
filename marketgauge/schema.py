"""Table schemas and the fixed values the rest of the package shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the two base tables.
ITEMS = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("pharmForm", T.StringType()),
    T.StructField("genericProduct", T.IntegerType()),
    T.StructField("salesIndex", T.IntegerType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("campaignIndex", T.StringType()),
    T.StructField("rrp", T.DoubleType()),
])

INTERACTIONS = T.StructType([
    T.StructField("lineID", T.LongType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("pid", T.LongType()),
    T.StructField("adFlag", T.IntegerType()),
    T.StructField("availability", T.IntegerType()),
    T.StructField("competitorPrice", T.DoubleType()),
    T.StructField("click", T.IntegerType()),
    T.StructField("basket", T.IntegerType()),
    T.StructField("order", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])

# Types of the derived feature table (29 columns), in output order.
FEATURES = T.StructType([
    T.StructField("lineID", T.LongType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("pid", T.LongType()),
    T.StructField("adFlag", T.IntegerType()),
    T.StructField("availability", T.IntegerType()),
    T.StructField("competitorPrice", T.DoubleType()),
    T.StructField("click", T.IntegerType()),
    T.StructField("basket", T.IntegerType()),
    T.StructField("order", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("content", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("pharmForm", T.StringType()),
    T.StructField("genericProduct", T.IntegerType()),
    T.StructField("salesIndex", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("rrp", T.DoubleType()),
    T.StructField("has_competitor", T.IntegerType()),
    T.StructField("campaignIndex_A", T.IntegerType()),
    T.StructField("campaignIndex_B", T.IntegerType()),
    T.StructField("campaignIndex_C", T.IntegerType()),
    T.StructField("price_diff_competitor", T.DoubleType()),
    T.StructField("price_ratio_competitor", T.DoubleType()),
    T.StructField("price_pct_diff_competitor", T.DoubleType()),
    T.StructField("is_post_shift_day", T.IntegerType()),
    T.StructField("price_diff_vs_previous_available_day", T.DoubleType()),
])

# Label sets, break days and bin edges.
ACTIONS = ["click", "basket", "order"]
CAMPAIGNS = ["A", "B", "C"]
SHIFT_DAY = 26
TEST_DAY = 79
VALID_DAY = 69
QUANTITY_CLASSES = ["1", "2", "3", "4-5", "6+"]
PRICE_CATEGORY_EDGES = [1.0, 6.0, 9.85, 16.45, 32.125]
POSITION_EDGES = [-0.20, -0.10, -0.05, 0.05, 0.10, 0.20]
POSITION_LABELS = [
    "much_cheaper",
    "cheaper",
    "slightly_cheaper",
    "at_market",
    "slightly_more_expensive",
    "more_expensive",
    "much_more_expensive",
]
OPERATING_POINTS = [("Default", 0.50), ("Balanced", 0.23), ("Recall-leaning", 0.20)]

# Columns a model must not see, per modelling task.
LEAKAGE = {
    "actions": ["click", "basket", "order", "revenue", "lineID"],
    "actions_no_ids": ["action", "click", "basket", "order", "revenue", "lineID", "pid"],
    "quantity": ["lineID", "pid", "click", "basket", "order", "revenue",
                 "quantity", "quantity_class"],
    "forest": ["order", "lineID", "pid", "click", "basket", "revenue", "rrp",
               "competitorPrice", "unit", "is_post_shift_day"],
}

# How the forest's 21 inputs are encoded.
FOREST_NUMERIC = [
    "day", "adFlag", "availability", "price", "has_competitor", "genericProduct", "salesIndex",
    "campaignIndex_A", "campaignIndex_B", "campaignIndex_C", "content", "price_diff_competitor",
    "price_ratio_competitor", "price_pct_diff_competitor",
    "price_diff_vs_previous_available_day", "price_over_rrp",
]
FOREST_ONE_HOT = ["pharmForm", "weekday"]
FOREST_TARGET = ["category", "manufacturer", "group"]
