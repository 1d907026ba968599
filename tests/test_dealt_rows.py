"""Prepared rows: dealt over the cores, chosen before they are prepared, dense for trees; curves and
losses from one pass."""

import math

import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from marketgauge.operators import models
from marketgauge.operators.staged import staged_log_loss
from marketgauge.session import cut_dealt


@pytest.fixture(scope="module")
def rows(spark):
    def unit(seed):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000

    return spark.range(900).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"), unit(3).alias("x"),
        F.when(unit(4) > 0.9, unit(5)).otherwise(0.0).alias("z"),
        (F.col("id") % 7).cast("string").alias("kind"),
        (unit(3) + unit(6) > 1).cast("double").alias("label")).cache()


def test_rows_of_one_file_are_dealt_over_the_cores(spark):
    one = spark.range(4000, numPartitions=1)
    dealt, n = cut_dealt(one, rows_per_task=1000)
    assert n == 4000 and len(dealt.inputFiles()) == 4
    assert sorted(r.id for r in dealt.collect()) == list(range(4000))
    sizes = dealt.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 1010
    assert len(cut_dealt(one, rows_per_task=5000)[0].inputFiles()) == 1


def test_rows_are_chosen_before_they_are_prepared(rows, monkeypatch):
    prep = models.Preprocessor(numeric=["x", "z"], target=["kind"], flags=True).fit(rows)
    every = models.fitting_rows(prep.transform_train(models.row_fold()), 100)
    written = []
    counted = models.cut_counted

    def noted(df, *args):
        out = counted(df, *args)
        written.append((df.columns, out[1]))
        return out

    monkeypatch.setattr(models, "cut_counted", noted)
    chosen = models.some_fitting_rows(prep, 100)
    assert all(n <= 100 for columns, n in written if "features" in columns)
    key = ["lineID", "features"]
    assert sorted(map(str, chosen.select(*key).collect())) == sorted(
        map(str, every.select(*key).collect()))
    assert models.some_fitting_rows(prep, None).count() == 900


def test_vectors_of_numbers_are_dense(rows):
    prep = models.Preprocessor(numeric=["x", "z"], flags=True).fit(rows)
    assert isinstance(prep.transform(rows.filter("z = 0")).first().features, DenseVector)


def test_curves_of_all_classes_are_those_of_each(rows):
    trained = models.fit(rows, models.tree(weight=None, min_leaf=20),
                         models.Preprocessor(numeric=["x", "z"]))
    got = models.partial_dependence_by_class(trained, rows, "x", [0.1, 0.8], ["no", "yes"], "name")
    assert got.columns == ["value", "mean_score", "rows", "name"]
    found = {(r["value"], r["name"]): (r["mean_score"], r["rows"]) for r in got.collect()}
    assert len(found) == 4
    for cls, name in enumerate(["no", "yes"]):
        for r in models.partial_dependence(trained, rows, "x", [0.1, 0.8], cls).collect():
            assert found[r["value"], name] == (pytest.approx(r["mean_score"]), 900)


def test_losses_are_summed_where_the_rows_are(spark):
    scored = spark.createDataFrame([(1.0, [0.5, 1.0]), (0.0, [0.25, 1.0]), (None, [0.5, 0.0])],
                                   "label double, scores array<double>")
    losses = staged_log_loss(scored, [2, 5], "label")
    got = {r.stage: (r.log_loss, r.rows) for r in losses.collect()}
    assert got[2] == (pytest.approx(-(math.log(0.5) + math.log(0.75) + math.log(0.5)) / 3), 3)
    # A sure and wrong score counts as 1e-15 away from it.
    assert got[5] == (pytest.approx(-math.log(1e-15) / 3, rel=1e-3), 3)
    # Scores are not exploded: a batch leaves one row for each stage.
    plan = losses._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
