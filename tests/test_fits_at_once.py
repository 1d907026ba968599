"""Fits of many rows run one by one, and searches score without exchanging rows."""

import pytest
from pyspark.sql import functions as F

from marketgauge.operators import models


@pytest.fixture
def widths(monkeypatch):
    """How many fits run at the same time, call by call."""
    seen, real = [], models.concurrently
    monkeypatch.setattr(models, "concurrently", lambda work, tasks, parallel=models.PARALLEL: (
        seen.append((len(tasks), parallel)), real(work, tasks, parallel))[1])
    return seen


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, 1.0, float(i % 3), float(i % 2), "abc"[i % 3])
                                  for i in range(90)],
                                 "lineID long, price double, x double, label double, g string")


def test_rows_bound_the_fits_at_once(spark, monkeypatch):
    assert models.at_once(1000, 8) == 8 and models.at_once(0, 8) == 8
    monkeypatch.setattr(models, "ROWS_AT_ONCE", 100)
    assert [models.at_once(n, 8) for n in (10, 30, 90, 1000)] == [8, 3, 1, 1]
    chosen = models.one_by_one(models.quantity_classifier(rounds=1), 50)
    assert chosen.getParallelism() == 2


@pytest.mark.parametrize("most,width", [(100, 1), (200, 2), (10_000, 3)])
def test_sweeps_of_many_rows_fit_one_by_one(rows, widths, monkeypatch, most, width):
    monkeypatch.setattr(models, "ROWS_AT_ONCE", most)
    make = lambda *_: (models.tree(depth=1, min_leaf=1), models.Preprocessor(numeric=["x"]))
    models.sweep_weights(rows, rows, "label", {n: F.lit(w) for n, w in (("a", 1.0), ("b", 2.0))},
                         make, parallel=3)
    models.sweep_alphas(rows, rows, "label", [0.0, 1.0], ["0", "1"], make, parallel=3)
    models.compare_feature_sets(rows, rows, "label", {"x": ["x"], "p": ["price"]}, lambda _: (
        models.tree(weight=None, depth=1, min_leaf=1), models.Preprocessor(numeric=["x"])),
        parallel=3)
    fits = [w for n, w in widths if n == 2]
    assert fits[0] == fits[2] == fits[3] == width


def test_large_groups_are_fitted_one_by_one(rows, widths, monkeypatch):
    monkeypatch.setattr(models, "ROWS_AT_ONCE", 90)
    more = rows.unionByName(rows.filter("g = 'a'")).unionByName(rows.filter("g = 'a'"))
    fitted = models.train_per_group(more, "g", lambda pooled: (
        models.tree(weight=None, depth=1, min_leaf=1), models.Preprocessor(numeric=["x"])),
        min_rows=10)
    assert sorted(fitted.own) == ["a", "b", "c"] and fitted.pooled is None
    # 90 rows of a alone, then 30 of b and of c together, and no rows of the pooled model.
    assert widths == [(1, 1), (2, 3), (1, 8)]


def test_class_search_exchanges_no_rows(spark, monkeypatch):
    """Rows that no other row shares a key with are told apart in place; others count once."""
    df = spark.range(300).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"), F.lit(1.0).alias("weight"),
        (F.pmod(F.xxhash64("id"), F.lit(300)) / 100).alias("x"))
    df = df.withColumn("label", F.when(F.col("lineID") % 10 > 0, F.floor("x")).otherwise(1)
                       .cast("double")).cache()
    make = lambda rounds: (models.quantity_classifier(rounds=rounds, depth=2),
                           models.Preprocessor(numeric=["x"]))
    keyed, real = [], models._by_key
    monkeypatch.setattr(models, "_by_key", lambda *a: (keyed.append(a[2].count()), real(*a))[1])
    tried = [{"rounds": 3}]
    search = lambda valid: models.tune_multiclass(df, valid, "label", ["a", "b", "c"], tried,
                                                  make)[0].first()
    plain = search(df)
    assert not keyed and 0.5 < plain.macro_f1 < 1
    # Twice the rows, and a row without a key that comes twice: each counts once.
    none = df.limit(1).withColumn("lineID", F.lit(None).cast("long"))
    twice = search(df.unionByName(df))
    assert keyed == [600] and (twice.macro_f1, twice.accuracy, twice.best_iter) == (
        plain.macro_f1, plain.accuracy, plain.best_iter)
    some = search(df.unionByName(none).unionByName(none))
    once = search(df.unionByName(none))
    assert keyed == [600, 2] and some.accuracy == once.accuracy


def test_staged_classes_are_those_of_highest_score(spark, rows):
    prep = models.Preprocessor(numeric=["x", "price"])
    fits = [models.fit(rows.withColumn("label", (F.col("x") == c).cast("double")),
                       models.boosted(weight=None, rounds=3, depth=1), prep) for c in range(3)]
    ready = prep.transform(rows).select("lineID", "features")
    one = [{r.lineID: r.scores for r in models.staged_scores(
        spark, f.model, ready, [1, 3]).collect()} for f in fits]
    found = models.staged_classes(spark, [f.model for f in fits], ready, [1, 3]).collect()
    assert len(found) == 90
    for r in found:
        for j, cls in enumerate(r.classes):
            scores = [s[r.lineID][j] for s in one]
            assert cls == scores.index(max(scores))
