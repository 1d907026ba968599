import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgauge.operators import evaluate, knn, models


@pytest.fixture
def scores(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    s = np.round(np.clip(0.3 * y + rng.random(600) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)],
                               "label int, score double")
    return df, y, s


def test_auc_and_ap_against_brute_force(scores):
    df, y, s = scores
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx(auc)
    flipped = df.withColumn("score", -F.col("score"))
    assert evaluate.roc_auc(flipped).first().roc_auc == pytest.approx(1 - auc)
    ap = 0.0
    for t in np.unique(s):
        ap += (y[s == t] == 1).sum() / y.sum() * y[s >= t].mean()
    assert evaluate.average_precision(df).first().average_precision == pytest.approx(ap)


def test_sweep_equals_direct_counts(scores):
    df, y, s = scores
    grid = [i / 20 for i in range(21)]
    for r in evaluate.threshold_sweep(df, grid).collect():
        hit = s >= r.threshold
        assert (r.tp, r.fp, r.fn) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(),
                                      (~hit & (y == 1)).sum())
    best = evaluate.best_threshold(evaluate.threshold_sweep(df, grid)).first()
    assert best.f1 == max(r.f1 for r in evaluate.threshold_sweep(df, grid).collect())


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, score double")
    r = evaluate.binary_metrics(df, 0.9).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_class_report_with_absent_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    rows = {r["class"]: r for r in evaluate.class_report(df, ["a", "b", "c"]).collect()}
    assert rows["c"].support == 0 and rows["c"].f1 == 0.0
    assert rows["a"].precision == 0.5 and rows["b"].recall == 0.0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    train = np.vstack([rng.normal(0, 1, (300, 5)), rng.normal(8, 0.1, (200, 5)),
                       np.zeros((40, 5))])
    query = np.vstack([rng.normal(0, 2, (30, 5)), rng.normal(8, 1, (10, 5)), np.zeros((1, 5))])
    labels = rng.integers(0, 3, len(train))
    t = spark.createDataFrame([(i, str(labels[i]), v.tolist()) for i, v in enumerate(train)],
                              "id long, label string, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)],
                              "id long, vec array<double>")
    # Small chunks and blocks, so a hot group is split on both sides.
    out = knn.nearest_neighbours(t, q, 5, pivots=8, train_chunk=30, query_block=4)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append((round(r.dist, 9), r.train_id))
    for i, v in enumerate(query):
        d = np.sqrt(((train - v) ** 2).sum(axis=1))
        want = sorted((round(float(x), 9), j) for j, x in enumerate(d))[:5]
        assert sorted(got[i]) == want
    votes = {r.id: r for r in knn.knn_vote(t, q, 5, pivots=8).collect()}
    assert len(votes) == len(query) and 0 < votes[40].score <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 75 + [(1,)] * 25, "y int")
    balanced = {r.y: r.weight for r in models.class_weights(df, "y", normalise=False).collect()}
    assert balanced == {0: pytest.approx(100 / 150), 1: pytest.approx(2.0)}
    flat = {r.weight for r in models.class_weights(df, "y", alpha=0.0).collect()}
    assert flat == {1.0}
    assert models.positive_ratio(df, "y") == 3.0


@pytest.fixture
def planted(spark):
    """A label that depends on x and on a category."""
    rng = np.random.default_rng(9)
    x, c = rng.random(800), rng.integers(0, 6, 800)
    y = (x + 0.15 * c + 0.2 * rng.random(800) > 0.9).astype(int)
    rows = [(i, float(i), float(a) if i % 11 else None, f"c{b}", float(z))
            for i, (a, b, z) in enumerate(zip(x, c, y))]
    return spark.createDataFrame(
        rows, "lineID long, price double, x double, c string, label double")


def test_model_finds_planted_signal_and_explains_it(planted):
    train, test = planted.filter("lineID % 4 > 0"), planted.filter("lineID % 4 = 0")
    prep = models.Preprocessor(numeric=["x"], target=["c"], flags=True)
    trained = models.fit(train, models.boosted(weight=None, rounds=5, depth=3), prep)
    scored = trained.score(test)
    assert [c for c in test.columns if c not in scored.columns] == []
    auc = evaluate.roc_auc(scored.select(F.col("label").cast("int").alias("label"), "score"))
    assert auc.first().roc_auc > 0.85
    names = [r.feature for r in models.feature_importance(trained).collect()]
    assert set(names) == {"x", "x_missing", "c_te"}
    drops = {r.feature: r.importance_mean for r in models.permutation_importance(
        trained, test, "label", ["x", "price"], repeats=2).collect()}
    assert drops["x"] > 0.05 and drops["price"] == pytest.approx(0.0)
    curve = sorted(models.partial_dependence(trained, test, "x", [0.0, 1.0]).collect())
    assert curve[0].mean_score < curve[1].mean_score and curve[0].rows == test.count()


def test_preprocessor_one_hot_and_unseen(planted, spark):
    prep = models.Preprocessor(numeric=["x"], one_hot=["c"], min_frequency=0.01, scale=True)
    prep.fit(planted)
    assert len(prep.names) == 1 + 7
    odd = spark.createDataFrame([(1, 1.0, 0.5, "new", 1.0)], planted.schema)
    vector = prep.transform(odd).first().features.toArray()
    assert vector[prep.names.index("c=__infrequent__")] == 1.0 and vector[1:].sum() == 1.0


def test_tree_rules_use_names(planted):
    trained = models.fit(planted, models.tree(weight=None, depth=2, min_leaf=5),
                         models.Preprocessor(numeric=["x"]))
    text = "\n".join(r.rule for r in models.tree_rules(trained).collect())
    assert "(x " in text and "feature 0" not in text
