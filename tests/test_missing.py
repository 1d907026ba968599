"""Missing strata, labels and scores, strict reading, and the life of written tables."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketgauge import session
from marketgauge.functions.text import parse_content
from marketgauge.operators import evaluate, knn, models, sampling
from marketgauge.plans import experiments
from marketgauge.sources import tables


@pytest.fixture(scope="module")
def strata(spark):
    rows = [(i, 1.0, None if i % 2 else "a") for i in range(20)]
    return spark.createDataFrame(rows, "lineID long, price double, kind string")


def counts(df, *by):
    return {tuple(r[c] for c in by): r["n"] for r in
            df.groupBy(*by).agg(F.count("*").alias("n")).collect()}


def test_null_is_a_stratum(strata):
    split = counts(sampling.stratified_split(strata, "kind", 0.2), "kind", "split")
    assert split == {("a", "test"): 2, (None, "test"): 2, ("a", "train"): 8, (None, "train"): 8}
    folds = counts(sampling.kfold(strata, "kind", 5), "kind", "fold")
    assert folds == {(k, f): 2 for k in ("a", None) for f in range(5)}
    some = strata.filter("lineID < 15 OR kind = 'a'")
    assert set(counts(sampling.oversample(some, "kind"), "kind").values()) == {10}
    labelled = strata.select("lineID", "price", (F.col("lineID") % 2).alias("order")).withColumn(
        "order", F.when(F.col("order") == 1, 1))
    assert sampling.stratified_sample(labelled, 10).count() == 10


def test_rows_without_a_score_are_not_flagged(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, 0.1), (0, None)],
                               "label int, score double")
    r = evaluate.binary_metrics(df, 0.5).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2) and r.recall == 0.5
    swept = evaluate.threshold_sweep(df, [0.05, 0.5]).collect()
    assert all(x.tp + x.fn == 2 for x in swept)
    # 1 before both negatives, the other positive after one and level with one.
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx((2 + 0.5) / 4)


def test_rows_without_a_label_weigh_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.0,), (None,)], "label double")
    weights = {r.label: r.weight for r in models.with_class_weight(df, "label").collect()}
    assert weights == {1.0: 0.75, 0.0: 1.5, None: 0.0}


@pytest.mark.parametrize("text,want", [
    ("10", 10), ("5X10", 50), (" 7.5 ", 7.5), ("1e2", 100), ("10D", None), ("10f", None),
    ("5X10D", None), ("inf", None), ("nan", None), ("PAK", None), (None, None)])
def test_content_takes_plain_numbers_only(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(parse_content("c").alias("v")).first().v == want


HEAD = "lineID|day|pid|adFlag|availability|competitorPrice|click|basket|order|price|revenue\n"


@pytest.mark.parametrize("row,wrong", [
    ("1|1|5|0|1||1|0|0|2.5|0", None), ("1|1|5.0|0|1|nan|1|0|0|2.5|0", None),
    ("1|1|x|0|1||1|0|0|2.5|0", "pid"), ("1|1.5|5|0|1||1|0|0|2.5|0", "day"),
    ("1|1|5|0|1|abc|1|0|0|2.5|0", "competitorPrice"), ("1|1|5|0|1||1|0|0|2.5d|0", "price")])
def test_bad_values_raise(spark, tmp_path, row, wrong):
    (tmp_path / "t.csv").write_text(HEAD + row + "\n")
    df = tables.read_interactions(spark, str(tmp_path / "t.csv"))
    if wrong:
        with pytest.raises(PySparkException, match=wrong):
            df.collect()
    else:
        r = df.first()
        assert (r.pid, r.competitorPrice, r.price) == (5, None, 2.5)


def test_whole_numbers_with_a_point_are_read(spark, tmp_path):
    (tmp_path / "i.csv").write_text(
        "pid|manufacturer|group|content|unit|pharmForm|genericProduct|salesIndex|category|"
        "campaignIndex|rrp\n1|m|g|10|ST| tab |0|40|7.0||2\n")
    assert tables.read_items(spark, str(tmp_path / "i.csv")).first().category == 7


def test_blanks_survive_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame([(" a ",)], "v string"), path)
    assert spark.read.option("sep", "|").option("header", True).csv(path).first().v == " a "


def test_search_does_not_see_validation_labels(spark):
    """Random labels and many keys: an encoding that knew them would score far from chance."""
    rows = spark.range(4000).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"),
        (F.xxhash64("id", F.lit(1)) % 1500).cast("string").alias("key"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("double").alias("label"))
    train, valid = rows.filter("lineID % 2 = 0"), rows.filter("lineID % 2 = 1")
    trials, _ = models.tune_random(train, valid, "label", [{}], lambda: (
        models.boosted(weight=None, rounds=3, depth=3), models.Preprocessor(target=["key"])))
    assert abs(trials.first().valid_roc_auc - 0.5) < 0.05


def test_k_search_prefers_the_k_that_fits(spark):
    rows = [(i, str(i % 2), [float(i % 2) * 3 + (i * 7 % 10) / 10, 1.0], i % 4) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label string, vec array<double>, fold int")
    out = {r.k: r for r in knn.k_search(df, "fold", [3, 5, 31]).collect()}
    assert out[3].rank == 1 and out[3].mean_accuracy == 1


def test_weighting_by_class(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 3), float(i % 3)) for i in range(90)],
                               "lineID long, price double, x double, label double")
    out = models.sweep_alphas(df, df, "label", [0.0, 1.0], ["0", "1", "2"],
                              lambda: (models.tree(depth=2, min_leaf=1),
                                       models.Preprocessor(numeric=["x"])))
    assert [r.alpha for r in out.collect()] == [0.0, 1.0] and out.first().macro_f1 == 1


def test_scratch_tables_go(spark):
    with session.scratch(spark) as folder:
        df = session.cut(spark.range(3))
        assert df.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.isdir(folder.removeprefix("file:"))
    assert session.run_folder(spark) not in folder[len(session.run_folder(spark)) + 1:]


def test_experiments_name_their_settings():
    estimator, _ = experiments.forest_parts(trees=7, split_width="0.3")
    assert estimator.getNumTrees() == 7 and estimator.getFeatureSubsetStrategy() == "0.3"
