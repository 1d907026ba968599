"""What model queries read, write and prepare: each thing once."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketgauge import schema
from marketgauge.operators import evaluate, models
from marketgauge.plans import experiments


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(i, float(i % 11), (i * 7 % 13) / 13, "abc"[i % 3] if i % 17 else None,
          None if i % 5 == 0 else float(i % 4), float(i % 13 > 6)) for i in range(400)],
        "lineID long, price double, x double, c string, y double, label double")


@pytest.fixture
def written(monkeypatch):
    """Columns of the tables that models and plans write."""
    seen, counted, cut = [], models.cut_counted, experiments.cut
    monkeypatch.setattr(models, "cut_counted", lambda df, *a: (
        seen.append(df.columns), counted(df, *a))[1])
    monkeypatch.setattr(experiments, "cut", lambda df, *a: (
        seen.append(df.columns), cut(df, *a))[1])
    return seen


def _prep(**params):
    return models.Preprocessor(numeric=["x", "y"], one_hot=["c"], splines=["price"],
                               target=["c"], min_frequency=0.01, scale=True, flags=True, **params)


def test_content_is_parsed_before_the_join(interactions, items):
    out = experiments.price_frame(interactions, items)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[:plan.index("Join")]
    found = {r.lineID: r.content for r in out.collect()}
    assert (found[1], found[6], found[8], found[9]) == (50.0, 10.0, None, None)


def test_fit_writes_what_it_reads(rows, written):
    models.fit(rows.withColumn("weight", F.lit(2.0)), models.logistic(maxIter=2), _prep())
    assert written[-1] == ["features", "label", "weight"]
    models.fit(rows, models.tree(weight=None), _prep())
    assert written[-1] == ["features", "label"]


def test_vectors_are_those_of_the_assembler(rows):
    prep = _prep().fit(rows)
    got = {r.lineID: (r.v, r.n) for r in prep.transform(rows).select(
        "lineID", vector_to_array("features").alias("v"),
        F.lit(len(prep.names)).alias("n")).collect()}
    staged = prep._assembler.transform(prep._prepare(prep._encoding.apply(rows)))
    want = {r.lineID: r.v for r in staged.select(
        "lineID", vector_to_array("features").alias("v")).collect()}
    assert {k: v for k, (v, _) in got.items()} == want and len(want) == 400
    assert all(len(v) == n for v, n in got.values())
    assert (prep.transform(rows).schema["features"].metadata
            == staged.schema["features"].metadata != {})
    plan = prep.transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 1


def test_many_levels_stay_sparse(rows, monkeypatch):
    want = [r.v for r in _prep().fit(rows).transform(rows).select(
        vector_to_array("features").alias("v")).collect()]
    monkeypatch.setattr(models, "MAX_DENSE", 2)
    got = _prep().fit(rows).transform(rows)
    assert [r.v for r in got.select(vector_to_array("features").alias("v")).collect()] == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("UDF(") > 1


def test_a_model_input_that_is_no_number_fails(rows):
    prep = models.Preprocessor(numeric=["x"]).fit(rows)
    odd = rows.limit(1).withColumn("x", F.lit(float("nan")))
    with pytest.raises(Exception, match="NaN"):
        prep.transform(odd).collect()


def test_action_report_scores_once(rows, written):
    coded = rows.withColumn("label", (F.col("lineID") % 3).cast("double"))
    trained = models.fit(coded, models.tree(weight=None), models.Preprocessor(numeric=["x"]))
    report = experiments.action_report(trained, coded).first()
    assert written[-1] == ["label", "prediction", *[f"p_{a}" for a in schema.ACTIONS]]
    assert report.accuracy > 0.3


def test_permuted_columns_swap_their_places(rows):
    prep = _prep()
    trained = models.fit(rows, models.boosted(weight=None, rounds=3, depth=3), prep)
    places = prep.places_of()
    for c, at in places.items():
        assert {prep.names[i].split("_sp")[0].split("=")[0] for i in at} <= {
            c, f"{c}_missing", f"{c}_te"}
    assert sorted(i for at in places.values() for i in at) == list(range(len(prep.names)))
    asked = ["x", "y", "c", "price", "lineID"]
    got = {r.feature: r for r in models.permutation_importance(
        trained, rows, "label", asked, repeats=2).collect()}
    # The plain way: each column of the rows is swapped, and all is prepared again.
    paired = models.permuted_rows(rows, asked, 2)
    whole = evaluate.roc_auc(trained.score(rows).select("label", "score")).first().roc_auc
    for f in asked:
        drops = [whole - evaluate.roc_auc(trained.score(paired.withColumn(
            f, F.col("_others")[i][f]).drop("_others")).select("label", "score")).first().roc_auc
            for i in range(2)]
        assert got[f].importance_mean == pytest.approx(sum(drops) / 2, abs=1e-12)
    assert got["x"].importance_mean > 0.1
    plan = models.permutation_importance(trained, rows, "label", ["lineID"], 2)
    assert [r.importance_mean for r in plan.collect()] == [0.0]
