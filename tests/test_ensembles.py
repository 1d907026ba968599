"""Staged scores, grid and random searches on them, isotonic curves in parts, group models."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from marketgauge.operators import isotonic, models
from marketgauge.operators.neighbour_information import neighbour_information
from marketgauge.operators.staged import staged_log_loss, staged_scores


@pytest.fixture(scope="module")
def rows(spark):
    unit = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000
    return spark.range(1200).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"), unit.alias("x"),
        (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1000)) / 1000).alias("z"),
        (unit * unit > F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)) / 1000).cast("double")
        .alias("label"), (F.col("id") % 3).cast("int").alias("fold")).cache()


def prepared(rows):
    prep = models.Preprocessor(numeric=["x", "z"]).fit(rows)
    return prep.transform(rows).cache()


@pytest.mark.parametrize("make", [
    lambda: models.forest(weight=None, trees=7, depth=6, min_leaf=3),
    lambda: models.boosted(weight=None, rounds=6, depth=3, rate=0.3)])
def test_stages_are_sums_over_first_trees(spark, rows, make):
    every = prepared(rows)
    model = make().fit(every)
    own = model.transform(every).select("lineID", vector_to_array("probability")[1].alias("p"))
    staged = staged_scores(spark, model, every.select("lineID", "label", "features"), [1, 4, 6, 7]
                           if model.getNumTrees == 7 else [1, 4, 6])
    got = staged.join(own, "lineID").collect()
    assert len(got) == 1200 and all(abs(r.scores[-1] - r.p) < 1e-12 for r in got)
    # Any stage by hand, tree by tree.
    some = every.filter("lineID < 20").select("lineID", "features").collect()
    scores = {r.lineID: r.scores for r in got}
    for r in some:
        if model.getNumTrees == 7:
            shares = [t.predictProbability(r.features)[1] for t in model.trees]
            assert scores[r.lineID][1] == pytest.approx(sum(shares[:4]) / 4)
        else:
            margin = sum(w * t.predict(r.features)
                         for w, t in list(zip(model.treeWeights, model.trees))[:4])
            assert scores[r.lineID][1] == pytest.approx(1 / (1 + math.exp(-2 * margin)))
    losses = {r.stage: r.log_loss for r in staged_log_loss(staged, [1, 4, 6], "label").collect()}
    by_hand = np.mean([-math.log(r.scores[1] if r.label else 1 - r.scores[1]) for r in got
                       if 0 < r.scores[1] < 1])
    if model.getNumTrees != 7:
        assert losses[4] == pytest.approx(by_hand)


def test_grid_scores_all_numbers_of_trees_from_one_forest(spark, rows, monkeypatch):
    fits = []
    real = models.staged_scores
    monkeypatch.setattr(models, "staged_scores",
                        lambda s, m, e, stages: fits.append(stages) or real(s, m, e, stages))
    grid = [{"trees": 2}, {"trees": 6}, {"trees": 4, "depth": 2}, {"trees": 6}]

    def make(trees, depth=5):
        return (models.forest(weight=None, trees=trees, depth=depth, min_leaf=5),
                models.Preprocessor(numeric=["x", "z"]))

    out = {r.cell: r for r in models.tune_grid(rows, "label", grid, make, fit_rows=500).collect()}
    assert sorted(out) == [0, 1, 2, 3] and sorted(map(tuple, fits)) == [(2, 6)] * 3 + [(4,)] * 3
    assert out[1].mean_test_auc == out[3].mean_test_auc > 0.6
    assert sorted(r.rank for r in out.values()) == [1, 2, 3, 4]
    assert all(abs(r.gap - (r.mean_train_auc - r.mean_test_auc)) < 1e-12 for r in out.values())


def test_fit_rows_are_exact(rows):
    assert models.fitting_rows(rows, 100).count() == 100
    assert models.fitting_rows(rows, None).count() == models.fitting_rows(rows, 5000).count() == 1200


def test_isotonic_in_parts_equals_one_pass(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.random(3000), 3)
    label = (rng.random(3000) < score ** 2).astype(float)
    df = spark.createDataFrame([(float(s), float(y)) for s, y in zip(score, label)],
                               "score double, label double")
    asked = spark.createDataFrame([(float(x),) for x in [-1, 0, 2, *rng.random(300)]] + [(None,)],
                                  "score double")
    plain = IsotonicRegression(featuresCol="score", labelCol="label").fit(df)
    want = [r.prediction for r in plain.transform(asked.dropna()).orderBy("score").collect()]
    for per, fan in ((100_000, 16), (50, 2), (7, 3)):
        blocks = isotonic.isotonic_blocks(df, points_per_part=per, fan_in=fan)
        values = [r.value for r in blocks.orderBy("lo").collect()]
        assert values == sorted(set(values))
        for most in (10 ** 6, 0):  # sent to all tasks, or placed by running totals
            out = isotonic.apply_isotonic(asked, blocks, max_bytes=most)
            got = [r.calibrated for r in out.dropna(subset=["score"]).orderBy("score").collect()]
            assert got == pytest.approx(want, abs=1e-9)
            assert out.filter("score is null").first().calibrated is None
    empty = isotonic.isotonic_blocks(df.limit(0))
    assert empty.count() == 0


def digamma(x):
    z = x + 20.0
    series = math.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4)
    return series - sum(1 / (x + j) for j in range(20))


def information(values, labels, k):
    """The estimate by all pairs."""
    pairs = [(round(v * 1e6), y) for v, y in zip(values, labels) if v is not None and y is not None]
    pairs = [(x, y) for x, y in pairs if sum(b == y for _, b in pairs) > 1]
    total, gain = len(pairs), 0.0
    for i, (x, y) in enumerate(pairs):
        same = sorted(abs(x - u) for j, (u, b) in enumerate(pairs) if b == y and j != i)
        near = min(k, len(same))
        radius = same[near - 1]
        m = sum(abs(x - u) < radius if radius else u == x for u, _ in pairs)
        gain += digamma(near) - digamma(len(same) + 1) - digamma(m)
    return max(0.0, digamma(total) + gain / total)


@pytest.mark.parametrize("k,block", [(3, 50_000), (1, 7), (5, 11)])
def test_neighbour_information(spark, k, block):
    rng = np.random.default_rng(1)
    label = [str(x) for x in rng.integers(0, 3, 300)] + ["rare", "two", "two", None]
    near = [float(int(y) + rng.normal()) if y and y.isdigit() else 0.5 for y in label]
    tied = [float(round(x)) if i % 9 else None for i, x in enumerate(near)]
    noise = [float(x) for x in rng.random(len(label))]
    noise[5] = float("nan")
    df = spark.createDataFrame(list(zip(label, near, tied, noise, [None] * len(label))),
                               "y string, near double, tied double, noise double, none double")
    got = {r["column"]: r.mi for r in neighbour_information(
        df.repartition(4), "y", ["near", "tied", "noise", "none"], k, block=block).collect()}
    noise[5] = None
    assert set(got) == {"near", "tied", "noise"}
    for name, values in (("near", near), ("tied", tied), ("noise", noise)):
        assert got[name] == pytest.approx(information(values, label, k), abs=1e-7)
    assert got["near"] > got["noise"]
    assert neighbour_information(df.limit(0), "y", ["near"]).count() == 0


def test_group_models(spark, rows):
    grouped = rows.withColumn("g", F.when(F.col("lineID") < 500, "large").when(
        F.col("lineID") < 900, "middle").when(F.col("lineID") < 1100, F.concat(
            F.lit("small"), (F.col("lineID") % 40).cast("string"))))
    made = []

    def make(pooled):
        made.append(pooled)
        return (models.boosted(weight=None, rounds=3, depth=2), models.Preprocessor(
            numeric=["x", "z"], target=["g"] if pooled else []))

    fitted = models.train_per_group(grouped, "g", make, min_rows=300)
    assert sorted(fitted.own) == ["large", "middle"] and made.count(True) == 1
    assert fitted.pooled.preprocessor.names == ["x", "z", "g_te"]
    scored = fitted.score(grouped.withColumn("extra", F.lit(1)))
    assert scored.columns == [*grouped.columns, "extra", "score", "pooled"]
    out = {r.lineID: r for r in scored.collect()}
    assert len(out) == 1200 and all(0 < r.score < 1 for r in out.values())
    assert {r.pooled for r in out.values() if r.lineID < 900} == {False}
    assert {r.pooled for r in out.values() if r.lineID >= 900} == {True}
    # A model of its own is the one fitted on the group's rows.
    own = models.fit(grouped.filter("g = 'large'").drop("g"), *make(False))
    alone = {r.lineID: r.score for r in own.score(grouped.filter("g = 'large'")).collect()}
    assert all(abs(out[i].score - s) < 1e-12 for i, s in alone.items())
    # However many groups there are, the number of models is bounded.
    assert not models.train_per_group(grouped, "g", make, min_rows=1, max_models=2).own
    one = models.train_per_group(grouped.withColumn("label", F.lit(1.0)), "g", make)
    assert not one.own and one.pooled is None
    assert one.score(grouped).filter("score is null").count() == 1200


def test_random_search_takes_the_best_round(spark, rows):
    train, valid = rows.filter("lineID % 2 = 0"), rows.filter("lineID % 2 = 1")

    def make(rate):
        return (models.boosted(weight=None, rounds=12, depth=4, rate=rate),
                models.Preprocessor(numeric=["x", "z"]))

    trials, best = models.tune_random(train, valid, "label", [{"rate": 0.9}, {"rate": 0.05}], make)
    found = {r.trial: r for r in trials.collect()}
    # A high rate fits noise after a few rounds.
    assert found[0].best_iter < 12 and found[0].best_iter <= found[1].best_iter
    chosen = max(found.values(), key=lambda r: r.valid_pr_auc)
    assert best.model.getNumTrees == chosen.best_iter


def test_class_search_takes_the_best_round(spark):
    df = spark.range(600).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"), F.lit(1.0).alias("weight"),
        (F.pmod(F.xxhash64("id"), F.lit(300)) / 100).alias("x"))
    df = df.withColumn("label", F.floor("x").cast("double")).cache()
    train, valid = df.filter("lineID % 3 > 0"), df.filter("lineID % 3 = 0")
    labels = ["a", "b", "c"]

    def make(rounds):
        return (models.quantity_classifier(rounds=rounds, depth=2),
                models.Preprocessor(numeric=["x"]))

    trials, best = models.tune_multiclass(train, valid, "label", labels, [{"rounds": 4}], make)
    row = trials.first()
    assert row.macro_f1 > 0.95 and 1 <= row.best_iter <= 4 and row["rank"] == 1
    plain = models.fit(train, *make(4))
    report = models.multiclass_report(plain, valid, "label", labels).first()
    assert row.macro_f1 >= report.macro_f1 - 1e-9
    assert models.multiclass_report(best, valid, "label", labels).first().accuracy > 0.95


def test_calibration_in_folds(spark, rows):
    def make():
        return (models.forest(weight=None, trees=5, depth=4, min_leaf=5),
                models.Preprocessor(numeric=["x", "z"]))

    fitted = models.calibrate_isotonic(rows, "label", "fold", make)
    out = fitted.score(rows)
    assert out.columns == [*rows.columns, "score"]
    found = {r.lineID: r.score for r in out.collect()}
    trained, _ = fitted.parts[0]
    held = trained.score(rows.filter("fold = 0")).select("score", "label")
    curve = IsotonicRegression(featuresCol="score", labelCol="label").fit(held)
    one = {r.lineID: r.p for r in curve.setPredictionCol("p").transform(
        trained.score(rows).select("lineID", "score")).collect()}
    mine = models.Calibrated(fitted.parts[:1]).score(rows).collect()
    assert all(abs(r.score - one[r.lineID]) < 1e-9 for r in mine)
    assert all(0 <= s <= 1 for s in found.values())
