"""Queries that train, tune and explain models, and the exact baselines around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions.features import action_label, quantity_class, quantity_rounded
from ..operators import evaluate, knn, models, sampling, stats
from ..plans import experiments
from ..session import cut
from .registry import q, query, rounded


@query("class_weights", f"""
WITH c AS (SELECT "order", count(*) AS n FROM interactions GROUP BY 1),
w AS (SELECT "order", n, ((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)) ** 0.5 AS d
  FROM c)
SELECT "order", n, {q('d / (SELECT avg(d) FROM w)')} AS weight FROM w""", ("interactions",))
def class_weights(t):
    return rounded(models.class_weights(t.interactions, "order", alpha=0.5))


@query("baseline_majority", f"""
WITH o AS (SELECT day, round_even(revenue / price, 0)::INTEGER AS u FROM interactions
  WHERE "order" = 1),
c AS (SELECT day, CASE WHEN u <= 3 THEN u::VARCHAR WHEN u <= 5 THEN '4-5' ELSE '6+' END AS k
  FROM o),
m AS (SELECT k FROM c WHERE day < 79 GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 1)
SELECT m.k AS prediction, count(*) AS n, {q('avg((c.k = m.k)::INT)')} AS accuracy
FROM c, m WHERE day >= 79 GROUP BY 1""", ("interactions",))
def baseline_majority(t):
    df = t.interactions.filter("order = 1").select(
        "day", quantity_class(quantity_rounded()).alias("label"))
    out = models.baseline_majority(df.filter("day < 79"), df.filter("day >= 79"), "label")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return rounded(out.groupBy("prediction").agg(F.count("*").alias("n"),
                                                 F.avg(hit).alias("accuracy")))


@query("baseline_mean", f"""
WITH o AS (SELECT day, revenue / price AS y FROM interactions WHERE "order" = 1),
m AS (SELECT avg(y) AS m FROM o WHERE day < 79)
SELECT {q('avg(abs(y - m))')} AS mae, {q('sqrt(avg((y - m) ** 2))')} AS rmse,
  {q('1 - sum((y - m) ** 2) / (var_pop(y) * count(*))')} AS r2 FROM o, m WHERE day >= 79""",
       ("interactions",))
def baseline_mean(t):
    df = t.interactions.filter("order = 1").select(
        "day", (F.col("revenue") / F.col("price")).alias("label"))
    out = models.baseline_mean(df.filter("day < 79"), df.filter("day >= 79"), "label")
    return rounded(evaluate.regression_metrics(out))


@query("knn_vote", f"""
WITH pairs AS (SELECT q.vec_id, t.label::VARCHAR AS label, t.vec_id AS t,
  list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS d
  FROM embeddings q, embeddings t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, t) <= 7),
weighted AS (SELECT vec_id, label, CASE WHEN bool_or(d = 0) OVER (PARTITION BY vec_id)
  THEN (d = 0)::INT ELSE 1 / d END AS w FROM near),
votes AS (SELECT vec_id, label, sum(w) AS w FROM weighted GROUP BY 1, 2)
SELECT vec_id AS id, arg_min(label, (-w, label)) AS prediction, {q('max(w) / sum(w)')} AS score
FROM votes GROUP BY 1""")
def knn_vote(t):
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), "label",
                                        F.col("embedding").alias("vec"))
    return rounded(knn.knn_vote(rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0"), k=7))


@query("knn_hashed_vote")
def knn_hashed_vote(t):
    """The vote over hash tables, with the recall measured on a twentieth of the queries."""
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), "label",
                                        F.col("embedding").alias("vec"))
    train, asked = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")
    found = cut(knn.hashed_neighbours(train, asked, 7))
    exact = knn.nearest_neighbours(train, asked.filter("id % 100 = 0"), 7)
    recall = knn.recall_of(found, exact).select("recall").scalar()
    return knn.votes_of(found).withColumn("recall", recall)


KS = list(range(3, 32, 2))
# Boosting rounds of the registered queries: of the two main order models (the reference's 300), of
# the search whose staged scores pick the best round, of other models, of a search over quantity
# models (75 class models) and of their weighting (35). The README has times.
ROUNDS, MANY, SOME, QUANTITY, FEW = 300, 100, 50, 10, 5


@query("knn_k_search", f"""
WITH pairs AS (SELECT q.vec_id, q.vec_id % 5 AS fold, q.label::VARCHAR AS truth,
  t.label::VARCHAR AS label, t.vec_id AS t,
  list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS d
  FROM embeddings q, embeddings t WHERE q.vec_id % 5 <> t.vec_id % 5),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, t) AS r FROM pairs
  QUALIFY r <= 31),
tried AS (SELECT * FROM near, (SELECT unnest({KS}) AS k) WHERE r <= k),
weighted AS (SELECT k, fold, vec_id, truth, label,
  CASE WHEN bool_or(d = 0) OVER (PARTITION BY k, vec_id) THEN (d = 0)::INT ELSE 1 / d END AS w
  FROM tried),
votes AS (SELECT k, fold, vec_id, truth, label, sum(w) AS w FROM weighted GROUP BY ALL),
chosen AS (SELECT k, fold, vec_id, truth, arg_min(label, (-w, label)) AS p FROM votes
  GROUP BY ALL),
hits AS (SELECT k, fold, avg((p = truth)::INT) AS a FROM chosen GROUP BY ALL),
means AS (SELECT k, avg(a) AS m, stddev_pop(a) AS s FROM hits GROUP BY k)
SELECT k, {q('m')} AS mean_accuracy, {q('s')} AS std_accuracy,
  row_number() OVER (ORDER BY round(m, 9) DESC, k)::INTEGER AS rank FROM means""")
def knn_k_search(t):
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), "label",
                                        F.col("embedding").alias("vec"),
                                        (F.col("vec_id") % 5).alias("fold"))
    return rounded(knn.k_search(rows, "fold", KS))


def frame(t):
    """Order label and model inputs per interaction, written once for all fits of a query."""
    df = experiments.price_frame(t.interactions, t.items).withColumn(
        "label", F.col("order").cast("double"))
    return cut(df.select("lineID", "label", *schema.ACTIONS, *experiments.NUMBERS,
                         *experiments.CATEGORIES, *experiments.TARGETS))


def sides(t):
    df = sampling.time_split(frame(t), [schema.VALID_DAY, schema.TEST_DAY])
    return [df.filter(F.col("split") == s).drop("split") for s in ("train", "valid", "test")]


def _order_report(trained, test):
    # Written: the report reads the scored rows twice.
    scored = cut(trained.score(test).select(F.col("order").alias("label"), "score"))
    return evaluate.binary_report(scored, 0.5)


def _action_frame(t):
    df = frame(t).withColumn("action", action_label())
    code = F.array_position(F.array(*map(F.lit, schema.ACTIONS)), F.col("action")) - 1
    df = df.withColumn("label", code.cast("double"))
    train, test = df.filter(F.col("day") < schema.TEST_DAY), df.filter(
        F.col("day") >= schema.TEST_DAY)
    return models.with_class_weight(train, "label"), test


def _action_report(trained, test):
    return experiments.action_report(trained, test)


@query("model_logistic")
def model_logistic(t):
    train, test = _action_frame(t)
    prep = models.Preprocessor(numeric=experiments.NUMBERS, one_hot=experiments.CATEGORIES,
                               min_frequency=0.01, scale=True)
    return _action_report(models.fit(train, models.logistic(), prep), test)


@query("model_tree")
def model_tree(t):
    """The tree on numbers as they are and on standardised ones."""
    train, test = _action_frame(t)
    reports = []
    for variant, scale in (("plain", False), ("scaled", True)):
        prep = models.Preprocessor(numeric=experiments.NUMBERS, one_hot=experiments.CATEGORIES,
                                   min_frequency=0.01, scale=scale)
        report = _action_report(models.fit(train, models.tree(), prep), test)
        reports.append(report.select(F.lit(variant).alias("variant"), "*"))
    return reports[0].unionByName(reports[1])


@query("model_additive")
def model_additive(t):
    train, test = _action_frame(t)
    prep = models.Preprocessor(numeric=["adFlag", "availability"], one_hot=experiments.CATEGORIES,
                               splines=["price", "day"], min_frequency=0.02, scale=True)
    return _action_report(models.fit(train, models.logistic(weight=None), prep), test)


@query("model_forest")
def model_forest(t):
    return experiments.forest_experiment(t.interactions, t.items)


@query("model_gbt")
def model_gbt(t):
    """Orders weigh as much as all other rows together."""
    train, valid, test = sides(t)
    both = train.unionByName(valid)
    ratio = models.positive_ratio(both, "order")
    weighted = both.withColumn("weight", F.when(F.col("order") == 1, ratio).otherwise(1.0))
    trained = experiments.boosted_fit(weighted, rounds=ROUNDS, depth=6, weight="weight")
    return _order_report(trained, test)


@query("history_model")
def history_model(t):
    return experiments.history_experiment(t.interactions, t.items, rounds=ROUNDS, depth=6)


@query("model_quantity")
def model_quantity(t):
    return experiments.quantity_experiment(t.interactions, t.items, rounds=SOME, depth=6)


@query("model_quantity_tree")
def model_quantity_tree(t):
    return experiments.quantity_tree_experiment(t.interactions, t.items)


@query("model_calibrated")
def model_calibrated(t):
    """Forests of 100 trees: one as it is, and five with a curve each from the fold they have not
    seen. Each is fitted on FIT_ROWS rows at most; curves and reports are of all rows."""
    train, valid, test = sides(t)
    folded = cut(sampling.kfold(train.unionByName(valid), "order", 5))
    estimator, prep = experiments.forest_parts()
    prep.fit(folded)
    rows = models.some_fitting_rows(prep).drop("fold")
    plain = models.Trained(prep, estimator.fit(rows).copy())
    calibrated = models.calibrate_isotonic(folded, "label", "fold", experiments.forest_parts,
                                           fit_rows=models.FIT_ROWS)
    both = (plain.score(test).select(F.lit("uncalibrated").alias("model"), "label", "score")
            .unionByName(calibrated.score(test).select(F.lit("calibrated").alias("model"),
                                                       "label", "score")))
    both = cut(both)
    return evaluate.brier(both, ["model"]).join(
        evaluate.ranking_metrics(both.withColumn("label", F.col("label").cast("int")),
                                 ["model"]), "model")


# The two grids of a forest search: depth and leaf size, then the width of a split and the trees.
FOREST_GRID = [{"depth": d, "min_leaf": m} for d in (None, 30) for m in (1, 10)]
FOREST_GRID += [{"depth": 30, "min_leaf": 10, "split_width": w, "trees": n}
                for w in ("sqrt", "0.3", "0.5") for n in (100, 200, 300)]


@query("tuning_report")
def tuning_report(t):
    """Both grids over five folds; 100 trees where a cell names no number."""
    train, _, _ = sides(t)
    folded = cut(sampling.kfold(train, "order", 5))
    return models.tune_grid(folded, "order", FOREST_GRID, experiments.forest_parts)


SEARCH = {"depth": [3, 4, 5, 6], "rate": [0.03, 0.05, 0.07, 0.1], "min_leaf": [1, 3, 5, 10],
          "subsample": [0.7, 0.85, 1.0]}
TRIALS = 15


@query("random_search")
def random_search(t):
    train, valid, test = sides(t)
    trials, best = models.tune_random(
        train, valid, "order", models.random_params(SEARCH, TRIALS),
        lambda **p: experiments.boosted_parts(rounds=MANY, **p))
    final = _order_report(best, test).select(F.col("roc_auc").alias("test_roc_auc"),
                                             F.col("pr_auc").alias("test_pr_auc")).first()
    return trials.withColumns({"test_roc_auc": F.lit(final.test_roc_auc),
                               "test_pr_auc": F.lit(final.test_pr_auc)})


@query("quantity_search")
def quantity_search(t):
    """Seven settings, ranked by macro-F1 of the five quantity classes on a validation part of the
    train orders; the best one, refitted on both, is scored on the test orders."""
    train, test = experiments.quantity_sides(t.interactions, t.items)
    space = {**SEARCH, "bins": [32, 64], "gain": [0.0, 0.001], "width": ["all", "sqrt"]}
    weighted = cut(models.with_class_weight(train, "label", 0.5, normalise=True))
    split = sampling.stratified_split(weighted, "label", 0.2, seed=43)
    fit_on, valid = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    trials, best = models.tune_multiclass(
        fit_on, valid, "label", schema.QUANTITY_CLASSES, models.random_params(space, TRIALS),
        lambda **p: experiments.quantity_parts(rounds=QUANTITY, **p))
    final = models.multiclass_report(best, test, "label", schema.QUANTITY_CLASSES).first()
    return trials.withColumns({"test_accuracy": F.lit(final.accuracy),
                               "test_macro_f1": F.lit(final.macro_f1)})


@query("alpha_sweep")
def alpha_sweep(t):
    train, test = experiments.quantity_sides(t.interactions, t.items)
    return models.sweep_alphas(
        train, test, "label", [0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0], schema.QUANTITY_CLASSES,
        lambda: experiments.quantity_parts(rounds=FEW))


def _weightings(train):
    ratio = models.positive_ratio(train, "order")
    return {name: F.when(F.col("order") == 1, w).otherwise(1.0)
            for name, w in (("1.0", 1.0), ("1.5", 1.5), ("ratio", float(ratio)))}


@query("weight_sweep")
def weight_sweep(t):
    train, valid, _ = sides(t)
    return models.sweep_weights(train, valid, "order", _weightings(train),
                                lambda: experiments.boosted_parts(rounds=SOME))


@query("select_bundle")
def select_bundle(t):
    train, valid, test = sides(t)
    return models.select_bundle(train, valid, test, "order", _weightings(train),
                                evaluate.sweep_grid(0.20, 0.80, 0.05),
                                lambda: experiments.boosted_parts(rounds=SOME))


@query("feature_set_comparison")
def feature_set_comparison(t):
    """The ten and fifteen numbers that tell most about an order, and all of them."""
    df = experiments.price_frame(t.interactions, t.items).withColumn(
        "label", F.col("order").cast("double"))
    df = sampling.time_split(cut(df.select("lineID", "label", "order",
                                           *dict.fromkeys(experiments.RANKED))),
                             [schema.VALID_DAY, schema.TEST_DAY])
    train, valid = (df.filter(F.col("split") == s).drop("split") for s in ("train", "valid"))
    ranked = [r["column"] for r in stats.mutual_information(
        train, "order", [], experiments.RANKED).collect()]
    sets = {"top_10": ranked[:10], "top_15": ranked[:15], "all": ranked}
    return models.compare_feature_sets(
        train, valid, "order", sets,
        lambda columns: experiments.boosted_parts(rounds=SOME, numeric=columns, target=[]))


@query("per_group_models")
def per_group_models(t):
    return experiments.per_group_experiment(t.interactions, t.items, "unit")


@query("feature_importance")
def feature_importance(t):
    train, _, _ = sides(t)
    return models.feature_importance(experiments.boosted_fit(train, rounds=SOME), top=15)


@query("logit_coefficients")
def logit_coefficients(t):
    train, _ = _action_frame(t)
    prep = models.Preprocessor(numeric=experiments.NUMBERS, one_hot=experiments.CATEGORIES,
                               min_frequency=0.01, scale=True)
    trained = models.fit(train, models.logistic(), prep)
    return models.coefficients(trained, schema.ACTIONS.index("order"), 15)


@query("tree_rules")
def tree_rules(t):
    train, _ = _action_frame(t)
    prep = models.Preprocessor(numeric=experiments.NUMBERS)
    return models.tree_rules(models.fit(train, models.tree(depth=4, min_leaf=200), prep))


@query("permutation_importance")
def permutation_importance(t):
    train, _, test = sides(t)
    trained = experiments.boosted_fit(train, rounds=SOME)
    return models.permutation_importance(
        trained, test, "order", [*experiments.NUMBERS, *experiments.TARGETS], repeats=5)


GRID = [0.1, 0.5, 0.9, 1.0, 1.1, 1.5, 2.0, 5.0, 10.0]


@query("partial_dependence")
def partial_dependence(t):
    train, _, test = sides(t)
    trained = experiments.boosted_fit(train, rounds=SOME)
    return models.partial_dependence(trained, test, "price_to_rrp_ratio", GRID)


@query("partial_dependence_by_action")
def partial_dependence_by_action(t):
    """The same curve for each class of the action model."""
    train, test = _action_frame(t)
    prep = models.Preprocessor(numeric=experiments.NUMBERS, one_hot=experiments.CATEGORIES,
                               min_frequency=0.01)
    trained = models.fit(train, models.tree(), prep)
    return models.partial_dependence_by_class(trained, test, "price_to_rrp_ratio", GRID,
                                              schema.ACTIONS, "action")
