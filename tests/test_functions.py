import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgauge import schema
from marketgauge.functions import features, text
from marketgauge.functions.bins import (equal_width_bin, labelled_bin, left_closed_bin,
                                        quantile_bin, right_closed_bin)
from marketgauge.functions.numbers import finite_or_null, ratio, round_half_even, safe_ln

CONTENT = [
    ("10", 10.0, 10.0, "numeric"), ("5X10", 50.0, 50.0, "multiplier"),
    ("30X0.6", 0.0, 18.0, "multiplier"), ("2X3X4", 24.0, 24.0, "multiplier"),
    ("PAK", None, None, "unknown"), ("L   125", None, None, "unknown"),
    (None, None, None, "missing"), (" 5x10 ", 50.0, 50.0, "multiplier"),
    ("0.5", 0.5, 0.5, "numeric"), ("XX", None, None, "unknown"),
]


def test_content(spark):
    df = spark.createDataFrame([(c[0],) for c in CONTENT], "content string")
    rows = df.select(text.parse_content("content"), text.parse_content("content", "float"),
                     text.classify_content("content")).collect()
    for row, (_, whole, exact, kind) in zip(rows, CONTENT):
        assert row[0] == whole
        assert row[1] == (pytest.approx(exact) if exact is not None else None)
        assert row[2] == kind


def test_normalize_text(spark):
    df = spark.createDataFrame([(" tab ",), (None,)], "x string")
    assert [r[0] for r in df.select(text.normalize_text("x")).collect()] == ["TAB", "UNKNOWN"]


def test_rounding_matches_numpy(spark):
    values = [0.125, 1.005, -0.125, 2.675, 0.375, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, None, 0.25]


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (-float("inf"),), (1.0,)],
                               "x double")
    assert [r[0] for r in finite_or_null(df).collect()] == [None, None, None, 1.0]


def test_safe_ln_clips(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "x double")
    got = [r[0] for r in df.select(safe_ln("x")).collect()]
    assert got == [pytest.approx(np.log(0.01)), None]


def test_bins_match_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 5, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    c = F.col("x")
    edges = [float(e) for e in np.quantile(x, np.linspace(0, 1, 11))]
    got = df.select(equal_width_bin(c, float(x.min()), float(x.max()), 20),
                    quantile_bin(c, edges)).toPandas()
    want = pd.cut(x, 20, labels=False, include_lowest=True) + 1
    assert (got.iloc[:, 0] == want).all()
    assert (got.iloc[:, 1] == pd.qcut(x, 10, labels=False, duplicates="drop") + 1).all()


def test_bin_borders_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (6.0,), (0.9,), (None,)], "x double")
    c = F.col("x")
    rows = df.select(left_closed_bin(c, [1.0, 6.0]), right_closed_bin(c, [1.0, 6.0]),
                     labelled_bin(c, [1.0, 6.0], ["a", "b", "c"])).collect()
    assert [tuple(r) for r in rows] == [(2, 1, "a"), (3, 2, "b"), (1, 1, "a"),
                                        (None, None, None)]


def test_competitor_features(interactions):
    clean = features.null_nonpositive(interactions)
    rows = {r.lineID: r for r in features.price_flags(features.competitor_gap(clean)).collect()}
    assert rows[4].competitorPrice is None and rows[6].competitorPrice is None
    assert rows[2].price_diff_competitor == 3.0
    assert rows[2].price_ratio_competitor == 1.375
    assert rows[2].price_pct_diff_competitor == 37.5
    assert rows[5].price_ratio_competitor is None and rows[5].is_cheaper_than_comp == 0
    assert (rows[3].is_cheaper_than_comp, rows[3].is_more_expensive_than_comp) == (0, 0)


def test_campaign_one_hot(items):
    rows = {r.pid: r for r in features.one_hot_fixed(items, "campaignIndex",
                                                     schema.CAMPAIGNS).collect()}
    assert "campaignIndex" not in rows[10].asDict()
    hot = [(r.campaignIndex_A, r.campaignIndex_B, r.campaignIndex_C) for r in rows.values()]
    assert hot == [(1, 0, 0), (0, 0, 0), (0, 0, 1)]


def test_pack_economics_zero_content(spark):
    df = spark.createDataFrame([(10.0, 20.0, 5.0, 0.0), (10.0, 20.0, 5.0, 2.0)],
                               "price double, rrp double, competitorPrice double, content double")
    zero, two = features.pack_economics(df).collect()
    assert zero.unit_price is None and zero.unit_price_to_rrp_ratio is None
    assert (two.unit_price, two.unit_price_to_rrp_ratio, two.unit_price_to_comp_ratio) == (
        5.0, 0.5, 2.0)


def test_calendar_bases(spark):
    df = spark.createDataFrame([(1,), (7,), (8,), (30,), (31,)], "day int")
    rows = features.calendar(df).collect()
    assert [(r.weekday, r.week_idx, r.month_idx) for r in rows] == [
        (1, 1, 1), (7, 1, 1), (1, 2, 1), (2, 5, 1), (3, 5, 2)]
    rows = features.calendar(df, base=0, first=0).collect()
    assert [(r.weekday, r.week_idx) for r in rows][:3] == [(1, 0), (0, 1), (1, 1)]


def test_quantity_classes(spark):
    df = spark.createDataFrame([(i,) for i in (1, 3, 4, 5, 6, None)], "q int")
    got = [r[0] for r in df.select(features.quantity_class(F.col("q"))).collect()]
    assert got == ["1", "3", "4-5", "4-5", "6+", None]


def test_position_bucket_uses_fractions(spark):
    df = spark.createDataFrame([(-0.3,), (-0.2,), (0.0,), (0.05,), (0.3,), (None,)], "g double")
    got = [r[0] for r in df.select(features.position_bucket(F.col("g"))).collect()]
    assert got == ["much_cheaper", "much_cheaper", "at_market", "at_market",
                   "much_more_expensive", None]
