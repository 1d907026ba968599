import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgauge import schema
from marketgauge.operators import (cleaning, encoders, explore, history, joins, ordered, sampling,
                                   stats)
from marketgauge.plans.unified import build_features


def test_unified_table(interactions, items):
    out = build_features(interactions, items)
    assert out.columns == schema.FEATURES.names and len(out.columns) == 29
    rows = {r.lineID: r for r in out.collect()}
    # Unparsable content and products without an item are gone.
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7]
    assert rows[1].content == 50.0 and rows[1].pharmForm == "TAB"
    assert rows[6].pharmForm == "UNKNOWN" and rows[6].category is None
    assert rows[5].is_post_shift_day == 1 and rows[4].is_post_shift_day == 0
    # First price of day 1 is the one of the smallest line; the gap in days does not matter.
    assert rows[1].price_diff_vs_previous_available_day is None
    assert rows[3].price_diff_vs_previous_available_day == 0.0
    assert rows[4].price_diff_vs_previous_available_day == -1.0
    assert rows[5].price_diff_vs_previous_available_day == 3.0


def test_history_never_sees_the_future(interactions):
    changed = interactions.withColumn(
        "order", F.when(F.col("day") >= 7, 1 - F.col("order")).otherwise(F.col("order")))
    for build in (lambda d: history.expanding_history(d, "pid"),
                  lambda d: history.rolling_history(d, "pid", 3), history.pid_history):
        a = {(r.pid, r.day): r for r in build(interactions).filter("day <= 7").collect()}
        b = {(r.pid, r.day): r for r in build(changed).filter("day <= 7").collect()}
        assert a == b and a


def test_expanding_history_values(interactions):
    rows = {(r.pid, r.day): r for r in history.expanding_history(interactions, "pid").collect()}
    assert rows[(10, 1)].historical_conversion_pid is None
    assert rows[(10, 1)].n_prior_appearances_pid == 0
    assert rows[(10, 7)].historical_conversion_pid == pytest.approx(2 / 3)
    assert rows[(10, 26)].n_prior_appearances_pid == 4


def test_skew_safe_join_equals_plain_join(spark):
    rows = [(i, 1 if i % 3 else i) for i in range(300)] + [(1000, None)]
    facts = spark.createDataFrame(rows, "id int, k int")
    table = spark.createDataFrame([(i, i * 2, f"v{i}") for i in range(0, 300, 2)] + [(1, 7, "hot")],
                                  "k int, a int, b string")
    want = sorted(facts.join(table, "k", "left").select("id", "k", "a", "b").collect(),
                  key=lambda r: r.id)
    for share in (0.001, 0.1, 0.9):
        got = joins.skew_safe_join(facts, table, ["k"], heavy_share=share)
        assert sorted(got.select("id", "k", "a", "b").collect(), key=lambda r: r.id) == want
    # The size check picks the same result on either side of the limit.
    got = joins.lookup(facts, table, ["k"], max_bytes=100).select("id", "k", "a", "b").collect()
    assert sorted(got, key=lambda r: r.id) == want


def test_enrich_keeps_unmatched_and_dedupes(interactions, items):
    doubled = items.unionByName(items)
    out = joins.enrich(interactions, doubled, dedupe=True)
    assert out.count() == 9
    assert out.filter("pid = 99").first().manufacturer is None
    assert joins.unmatched_rows(interactions, items).first().unmatched_rows == 1
    assert [r.pid for r in joins.orphan_keys(interactions, items, "pid").collect()] == [99]


@pytest.mark.parametrize("limit,accuracy", [(0, 10_000), (0, 10), (0, None), (10**9, 10_000)])
def test_quantiles_all_ways(spark, limit, accuracy):
    rng = np.random.default_rng(0)
    values = np.round(rng.lognormal(1, 1, 2000), 2)
    groups = rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)]
                               + [(0, None), (None, 1.0)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    rows = ordered.exact_quantiles(df, ["v"], probs, by=["g"], distinct_limit=limit,
                                   rank_all_limit=0 if accuracy else 10**9,
                                   accuracy=accuracy).collect()
    assert sorted(r.g for r in rows) == [0, 1, 2]
    for r in rows:
        assert r.quantiles == pytest.approx(list(np.quantile(values[groups == r.g], probs)))


def test_running_totals_do_not_depend_on_partitions(spark):
    rows = [(g, v, 1 + v % 3) for g in (1, 2) for v in range(50)]
    df = spark.createDataFrame(rows, "g int, v int, n int").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = ordered.running_totals(df, ["g"], ["v"], ["n"], descending=True).collect()
            got = {(r.g, r.v): r.cum_n for r in out}
            assert got == {(g, v): sum(1 + w % 3 for w in range(v, 50))
                           for g in (1, 2) for v in range(50)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_coverage_threshold_cases(spark):
    def threshold(counts, target):
        rows = [(v,) for v, n in counts.items() for _ in range(n)]
        df = spark.createDataFrame(rows, "v string")
        return encoders.coverage_threshold(df, ["v"], target).first().threshold

    assert threshold({"a": 90, "b": 5, "c": 3, "d": 2}, 0.95) == 3
    assert threshold({"a": 99, "b": 1}, 0.95) == 99
    assert threshold({"a": 5, "b": 5, "c": 5, "d": 5}, 0.5) == 5
    assert threshold({"a": 3, "b": 1}, 1.0) == 1
    assert threshold({"a": 6, None: 3, "b": 1}, 0.95) == 1


def test_group_rare_keeps_null(spark):
    rows = [("a",)] * 90 + [(None,)] * 6 + [("b",)] * 3 + [("c",)]
    df = spark.createDataFrame(rows, "v string")
    out = encoders.group_rare(df, ["v"], 0.95)
    assert {r.v: r["count"] for r in out.groupBy("v").count().collect()} == {
        "a": 90, None: 6, "other": 4}


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "v string")
    out = encoders.one_hot(df, ["v"], drop_first=True)
    assert out.columns == ["v_b", "v_c"]
    assert all(sum(r) <= 1 for r in out.collect())
    with pytest.raises(ValueError):
        encoders.levels(df, "v", limit=2)


def test_target_encoding_ignores_own_fold(spark):
    rows = [(i, "a" if i % 2 else "b", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v string, y int")
    fold = F.col("id") % 5
    changed = df.withColumn("y", F.when(fold == 2, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (encoders.target_encode_cv(d, ["v"], "y", fold).filter("id % 5 = 2")
            for d in (df, changed))
    assert sorted((r.id, r.v_te) for r in a.collect()) == sorted(
        (r.id, r.v_te) for r in b.collect())


def test_spline_sums_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 101, 5)], "x double")
    out = encoders.spline_basis(df, ["x"]).collect()
    # With the left-out last spline the pieces add up to one; at the top it carries 1/6.
    assert [sum(r[1:]) for r in out][0] == pytest.approx(1.0)
    assert sum(out[-1][1:]) == pytest.approx(5 / 6)


def test_sample_is_exact_and_seeded(spark):
    rows = [(i, float(i), int(i % 4 == 0), 1 + i % 30) for i in range(3000)]
    df = spark.createDataFrame(rows, "lineID long, price double, order int, day int")
    a = sampling.stratified_sample(df, 500)
    b = sampling.stratified_sample(df.repartition(9), 500)
    ids = {r.lineID for r in a.collect()}
    assert len(ids) == 500 and ids == {r.lineID for r in b.collect()}
    share = a.agg(F.avg("order").alias("m")).first().m
    assert share == pytest.approx(0.25, abs=0.01)
    assert sampling.stratified_sample(df, 5000).count() == 3000
    assert sampling.random_sample(df, 77).count() == 77
    with pytest.raises(KeyError):
        sampling.sample_strata(df.drop("order"), 10)


def test_tiny_strata_fall_back_to_order(spark):
    rows = [(i, float(i), i % 2, 7 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "lineID long, price double, order int, day int")
    assert sampling.sample_strata(df, 10)[1] == ["order"]
    assert sampling.stratified_sample(df, 10).groupBy("order").count().first()["count"] == 5


def test_split_and_folds(spark):
    rows = [(i, 1.0, int(i % 4 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "lineID long, price double, order int")
    split = sampling.stratified_split(df, "order", 0.2)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"test": 201, "train": 802}
    # One row more or less is all the drift there can be.
    assert all(r.drift <= 1 / 201 for r in sampling.split_drift(split, "order").collect())
    folds = sampling.kfold(df, "order", 5).groupBy("order", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in folds if r.order == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    ranks = sampling.hash_ranks(df, ["lineID"], 3, bits=4).select("rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 1004))


def test_oversample_balances(spark):
    rows = [(i, 1.0, 0 if i < 70 else 1 if i < 100 else 2) for i in range(107)]
    df = spark.createDataFrame(rows, "lineID long, price double, y int")
    out = sampling.oversample(df, "y")
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 70, 1: 70, 2: 70}


def test_day_splits(spark):
    df = spark.createDataFrame([(d,) for d in range(1, 93)], "day int")
    out = sampling.day_share_split(df, [0.7, 0.85]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 64, "valid": 14, "test": 14}


def test_null_keys_and_labels(interactions, items):
    joined = joins.enrich(interactions, items)
    assert explore.order_rate_by(joined, "campaignIndex").count() == 2
    named = explore.order_rate_by(joined, "campaignIndex", null_label="None").collect()
    assert {r.campaignIndex: r.n for r in named} == {"A": 5, "C": 1, "None": 3}


def test_box_stats_of_nothing_raises(spark):
    with pytest.raises(ValueError):
        ordered.quantile_values(spark.createDataFrame([(None,)], "x double"), "x", [0.5])


def test_cramers_v_yates(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 15 + [("b", "y")] * 25
    df = spark.createDataFrame(rows, "a string, b string")
    plain = stats.cramers_v(df, "a", "b", yates=False).first().chi2
    fixed = stats.cramers_v(df, "a", "b").first().chi2
    # n (ad - bc)^2 / products, with |ad - bc| - n / 2 for the corrected one.
    det = 30 * 25 - 10 * 15
    assert plain == pytest.approx(80 * det**2 / (40 * 40 * 45 * 35))
    assert fixed == pytest.approx(80 * (det - 40)**2 / (40 * 40 * 45 * 35))


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (10.0, None)],
                               "x double, c string")
    assert cleaning.medians(df, ["x"]) == {"x": 3.0}
    assert cleaning.modes(df, ["c"]) == {"c": "b"}
    flagged = cleaning.flag_and_fill(df, "x", 1.0).collect()
    assert [(r.x, r.x_missing) for r in flagged] == [(1.0, 0), (3.0, 0), (1.0, 1), (10.0, 0)]
