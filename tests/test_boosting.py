"""Boosted trees grown by tasks that keep their rows are those of MLlib, on all rows and rounds."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketgauge.catalog import QUERIES
from marketgauge.operators import boosting, models


def table(spark, n):
    def unit(seed):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000
    return spark.range(n).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"), unit(1).alias("x"),
        F.round(unit(2), 1).alias("z"), F.when(F.col("id") % 7 > 0, (F.col("id") % 4)).alias("u"),
        (1 + F.col("id") % 3).cast("double").alias("w"),
        (unit(1) * unit(2) + unit(3) / 2 > 0.5).cast("double").alias("label"))


def scores(model, rows):
    return {r.lineID: r.p for r in model.transform(rows).select(
        "lineID", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    df = table(spark, 3000)
    prep = models.Preprocessor(numeric=["x", "z", "u"], flags=True).fit(df)
    return prep.transform(df).cache()


def plain(estimator):
    """The same fit done by MLlib."""
    return GBTClassifier(**{p.name: v for p, v in estimator.extractParamMap().items()
                            if estimator.isSet(p)})


@pytest.mark.parametrize("per_task", [10 ** 9, 700])
def test_trees_are_those_of_mllib(spark, rows, monkeypatch, per_task):
    """In one task, and in several that add up their sums."""
    monkeypatch.setattr(boosting, "ROWS_OF_A_TASK", per_task)
    monkeypatch.setattr(boosting, "CHUNK", 256)
    estimator = models.boosted(weight=None, rounds=8, depth=4, minInstancesPerNode=5)
    mine, other = estimator.fit(rows), plain(estimator).fit(rows)
    want = scores(other, rows)
    got = scores(mine, rows)
    assert len(got) == 3000 and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert mine.totalNumNodes == other.totalNumNodes and mine.getNumTrees == 8
    assert np.allclose(mine.featureImportances.toArray(), other.featureImportances.toArray())
    assert mine.uid == estimator.uid and mine.getMaxIter() == 8


def test_weighted_trees_are_those_of_mllib(spark):
    df = table(spark, 2000).withColumn("x", F.round("x", 1))
    rows = models.Preprocessor(numeric=["x", "z", "u"]).fit(df).transform(df).cache()
    estimator = models.boosted(weight="w", rounds=6, depth=3)
    want, got = scores(plain(estimator).fit(rows), rows), scores(estimator.fit(rows), rows)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_class_models_are_those_of_one_against_the_rest(spark, rows):
    named = rows.withColumn("label", (F.col("lineID") % 2 + (F.col("x") > 0.7).cast("int"))
                            .cast("double"))
    estimator = models.quantity_classifier(weight="w", rounds=4, depth=3)
    whole = OneVsRest(classifier=plain(estimator.getClassifier()), labelCol="label")
    few = named.withColumn("w", F.lit(2.0))
    got = {r.lineID: r.prediction for r in estimator.fit(few).transform(few).collect()}
    want = {r.lineID: r.prediction for r in whole.fit(few).transform(few).collect()}
    assert got == want and len(set(got.values())) > 1


def test_bin_edges_are_those_mllib_draws(spark):
    """Of more rows than MLlib takes for bin edges, with weights and with zeros among the values."""
    df = table(spark, 25_000).withColumn("x", F.col("x") + F.rand(5)).withColumn(
        "w", F.when(F.col("lineID") % 3 > 0, 1.0).otherwise(2.5))
    rows = models.Preprocessor(numeric=["x", "z", "u"], flags=True).fit(df).transform(df).select(
        "lineID", "label", "w", "features").cache()
    for weight in (None, "w"):
        estimator = models.boosted(weight=weight, rounds=2, depth=4)
        want, got = scores(plain(estimator).fit(rows), rows), scores(estimator.fit(rows), rows)
        assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_a_share_of_rows_and_inputs(spark, rows):
    """Drawn rows and inputs differ by tree, and all rows get the scores of all trees."""
    estimator = models.boosted(weight=None, rounds=5, depth=3, subsamplingRate=0.5,
                               featureSubsetStrategy="sqrt")
    model = estimator.fit(rows)
    n = [t._call_java("rootNode").impurityStats().rawCount() for t in model.trees]
    assert all(1300 < k < 1700 for k in n) and len(set(n)) > 1
    assert len(scores(model, rows)) == 3000


def test_what_is_not_grown_here_goes_to_mllib(spark, rows):
    early = models.boosted(weight=None, rounds=3, depth=2, validationIndicatorCol="held")
    held = rows.withColumn("held", F.col("lineID") % 5 == 0)
    assert not boosting.suits(early, 6) and early.fit(held).getNumTrees <= 3
    assert boosting.fit_all(rows.limit(0), [models.boosted(weight=None)]) is None


def test_searches_fit_on_all_rows(spark, monkeypatch):
    """More rows than the searches were once held to."""
    df = table(spark, 8000).withColumn("fold", (F.col("lineID") % 2).cast("int")).cache()
    seen, real = [], boosting.fit_all
    monkeypatch.setattr(boosting, "fit_all", lambda rows, *a: (
        seen.append(rows.count()), real(rows, *a))[1])
    train, valid = df.filter("lineID % 8 > 0"), df.filter("lineID % 8 = 0")
    prep = lambda: models.Preprocessor(numeric=["x", "z"])
    models.tune_random(train, valid, "label", [{}], lambda: (
        models.boosted(weight=None, rounds=2, depth=2), prep()))
    assert seen[0] == 7000
    seen.clear()
    models.tune_multiclass(train.withColumn("weight", F.lit(1.0)), valid.withColumn(
        "weight", F.lit(1.0)), "label", ["a", "b"], [{}], lambda: (
        models.quantity_classifier(rounds=2, depth=2), prep()))
    assert seen[0] == 7000
    sizes, grow = [], models.Forest._fit
    monkeypatch.setattr(models.Forest, "_fit", lambda self, rows: (
        sizes.append(rows.count()), grow(self, rows))[1])
    models.tune_grid(df, "label", [{}], lambda: (
        models.forest(weight=None, trees=2, depth=3), prep()))
    assert sizes == [4000, 4000]


@pytest.mark.parametrize("name", ["model_gbt", "history_model"])
def test_order_models_have_all_rounds(spark, monkeypatch, name):
    asked = []

    class Stop(Exception):
        pass

    def fit(train, estimator, prep):
        asked.append((estimator.getMaxIter(), estimator.getMaxDepth()))
        raise Stop

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(Stop):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [(300, 6)]


def test_forest_has_all_trees(spark, monkeypatch):
    from marketgauge.plans import experiments
    asked = []
    monkeypatch.setattr(experiments.models, "fit", lambda train, estimator, prep: asked.append((
        estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode())))
    with pytest.raises(AttributeError):
        QUERIES["model_forest"](spark, "/root/testdata/sf0.001")
    assert asked == [(300, 30, 10)]
