"""Modelling flows: which rows, which columns, which model, which report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.features import (competitor_gap, null_nonpositive, pack_economics, price_flags,
                                  quantity_class, quantity_rounded, rrp_position)
from ..functions.text import parse_content
from ..operators import evaluate, history, joins, models, sampling
from ..operators.cleaning import period_filter
from ..session import cut
from .unified import build_features, model_frame

# Inputs of the price models.
NUMBERS = ["price", "price_to_rrp_ratio", "price_pct_diff_competitor", "unit_price",
           "is_cheaper_than_comp", "availability", "adFlag", "day"]
# All numbers a feature ranking chooses from.
RANKED = [*NUMBERS, "competitorPrice", "rrp", "content", "has_competitor", "salesIndex",
          "genericProduct", "price_ratio_competitor", "discount_to_rrp_pct",
          "is_more_expensive_than_comp", "is_undercutting_competitor", "unit_rrp",
          "unit_competitor_price", "unit_price_to_rrp_ratio", "unit_price_to_comp_ratio"]
CATEGORIES = ["unit", "pharmForm"]
TARGETS = ["manufacturer", "category"]
HISTORY = ["historical_conversion_pid", "historical_avg_price_pid", "n_prior_appearances_pid",
           "price_vs_hist_avg_pid", "historical_conversion_manufacturer",
           "historical_conversion_group"]


def price_frame(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with their items, price-position and pack features. A pack content is parsed
    once for its product, not for each of its rows."""
    parsed = items.withColumn("content", parse_content("content"))
    df = joins.enrich(null_nonpositive(interactions), parsed)
    return pack_economics(price_flags(rrp_position(competitor_gap(df, scale="fraction"))))


def boosted_parts(rounds: int = 100, depth: int = 6, rate: float = 0.1, min_leaf: int = 1,
                  subsample: float = 1.0, weight: str | None = None,
                  numeric: Sequence[str] = tuple(NUMBERS),
                  target: Sequence[str] = tuple(TARGETS)):
    """Boosted trees over numbers with missing flags and target-encoded categories."""
    estimator = models.boosted(weight=weight, rounds=rounds, depth=depth, rate=rate,
                               minInstancesPerNode=min_leaf, subsamplingRate=subsample)
    return estimator, models.Preprocessor(numeric=list(numeric), target=list(target), flags=True)


def boosted_fit(train: DataFrame, **params) -> models.Trained:
    return models.fit(train, *boosted_parts(**params))


def forest_parts(trees: int = 100, depth: int | None = 30, min_leaf: int = 10,
                 split_width: str = "sqrt"):
    """`split_width`: share of the inputs tried at a split ("sqrt", "0.3", "0.5"). `depth` None is
    as deep as MLlib goes."""
    estimator = models.forest(weight=None, trees=trees,
                              depth=models.DEEPEST if depth is None else depth,
                              min_leaf=min_leaf, featureSubsetStrategy=split_width)
    return estimator, models.Preprocessor(numeric=NUMBERS, target=TARGETS, flags=True)


def forest_experiment(interactions: DataFrame, items: DataFrame, trees: int = 300,
                      depth: int = 30, min_leaf: int = 10) -> DataFrame:
    """Unified table from the shift day on, stratified 80/20 split, routed preparation, balanced
    forest; test report at 0.5."""
    df = model_frame(period_filter(build_features(interactions, items), lo=schema.SHIFT_DAY))
    df = cut(df.withColumn("label", F.col("order").cast("double")))
    split = sampling.stratified_split(df, "order", 0.2)
    train = models.with_class_weight(split.filter(F.col("split") == "train").drop("split"),
                                     "label")
    test = split.filter(F.col("split") == "test").drop("split")
    prep = models.Preprocessor(numeric=schema.FOREST_NUMERIC, one_hot=schema.FOREST_ONE_HOT,
                               target=schema.FOREST_TARGET, flags=True)
    trained = models.fit(train, models.forest(trees=trees, depth=depth, min_leaf=min_leaf), prep)
    # Written: the report reads the scored rows twice.
    scored = cut(trained.score(test).select(F.col("order").alias("label"), "score"))
    return evaluate.binary_report(scored, 0.5)


def history_experiment(interactions: DataFrame, items: DataFrame, rounds: int = 100,
                       depth: int = 6) -> DataFrame:
    """Boosted trees with and without strictly-past history, time split at the test day; the
    threshold is chosen on the validation days."""
    # Only what the history and the models read is written and exchanged.
    columns = [*NUMBERS, *TARGETS]
    df = price_frame(interactions, items).select(
        *dict.fromkeys(["lineID", "pid", "group", "order", "click", *columns]))
    df = history.add_expanding_history(df).withColumn("label", F.col("order").cast("double"))
    df = cut(df.select("lineID", "day", "order", "label", *[c for c in NUMBERS if c != "day"],
                       *TARGETS, *HISTORY))
    split = sampling.time_split(df, [schema.VALID_DAY, schema.TEST_DAY])
    train, valid, test = (split.filter(F.col("split") == s).drop("split")
                          for s in ("train", "valid", "test"))
    reports = []
    for name, numeric in (("price", NUMBERS), ("price_and_history", [*NUMBERS, *HISTORY])):
        trained = boosted_fit(train, rounds=rounds, depth=depth, numeric=numeric)
        # Written: the sweep and the report read the scored rows twice.
        checked, scored = (cut(trained.score(part).select(F.col("order").alias("label"), "score"))
                           for part in (valid, test))
        point = evaluate.best_threshold(
            evaluate.threshold_sweep(checked, evaluate.sweep_grid())).first()
        reports.append(evaluate.binary_report(scored, point.threshold).select(
            F.lit(name).alias("model"), F.lit(point.threshold).alias("threshold"), "*"))
    return reports[0].unionByName(reports[1])


def action_report(trained: models.Trained, test: DataFrame) -> DataFrame:
    """Multiclass report of an action model. The scored rows are written: the report reads them
    twice."""
    out = trained.predict(test)
    p = vector_to_array("probability")
    names = F.array(*map(F.lit, schema.ACTIONS))
    rows = cut(out.select(
        F.element_at(names, F.col("label").cast("int") + 1).alias("label"),
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"),
        *[p[i].alias(f"p_{a}") for i, a in enumerate(schema.ACTIONS)]))
    return evaluate.multiclass_metrics(rows, schema.ACTIONS,
                                       probabilities={a: f"p_{a}" for a in schema.ACTIONS})


def _orders(interactions: DataFrame, items: DataFrame) -> DataFrame:
    df = price_frame(interactions, items)
    return cut(df.filter(F.col("order") == 1).withColumn("quantity", quantity_rounded()))


def quantity_sides(interactions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test orders with `label`, the number of the quantity class: exact shares of each
    class."""
    df = _orders(interactions, items).withColumn("quantity_class",
                                                 quantity_class(F.col("quantity")))
    classes = F.array(*map(F.lit, schema.QUANTITY_CLASSES))
    df = df.withColumn("label", (F.array_position(classes, F.col("quantity_class")) - 1)
                       .cast("double"))
    split = sampling.stratified_split(df, "quantity_class", 0.2)
    return tuple(split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


def quantity_parts(rounds: int = 100, depth: int = 6, rate: float = 0.1, min_leaf: int = 1,
                   subsample: float = 1.0, bins: int = 32, gain: float = 0.0,
                   width: str = "all"):
    """Boosted trees one against the rest; all seven settings of the search."""
    estimator = models.quantity_classifier(
        rounds=rounds, depth=depth, rate=rate, minInstancesPerNode=min_leaf,
        subsamplingRate=subsample, maxBins=bins, minInfoGain=gain, featureSubsetStrategy=width)
    return estimator, models.Preprocessor(numeric=NUMBERS, one_hot=["unit"], flags=True)


def quantity_experiment(interactions: DataFrame, items: DataFrame, rounds: int = 100,
                        depth: int = 6, alpha: float = 0.5) -> DataFrame:
    """Five quantity classes, damped class weights, boosted trees one against the rest."""
    train, test = quantity_sides(interactions, items)
    weighted = models.with_class_weight(train, "label", alpha=alpha, normalise=True)
    trained = models.fit(weighted, *quantity_parts(rounds=rounds, depth=depth))
    return models.multiclass_report(trained, test, "label", schema.QUANTITY_CLASSES)


def quantity_tree_experiment(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Quantity as a number: depth-5 tree against the mean, random 80/20 split."""
    df = _orders(interactions, items).withColumn("label", F.col("quantity").cast("double"))
    split = sampling.random_split(df, 0.2)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    prep = models.Preprocessor(numeric=NUMBERS, one_hot=["unit"], flags=True)
    tree = models.fit(train, models.quantity_tree(), prep).predict(test)
    mean = models.baseline_mean(train, test, "label")
    return (evaluate.regression_metrics(tree).select(F.lit("tree").alias("model"), "*")
            .unionByName(evaluate.regression_metrics(mean).select(F.lit("mean").alias("model"),
                                                                  "*")))


def per_group_experiment(interactions: DataFrame, items: DataFrame, group: str,
                         rounds: int = 50, depth: int = 6, min_rows: int = 1000) -> DataFrame:
    """One boosted model for each large group, the constant group column left out, and one for the
    rest with the group as an input; a test report for each group. Rows without a group are told
    as "(none)"."""
    df = price_frame(interactions, items)
    df = cut(df.withColumn("label", F.col("order").cast("double")))
    split = sampling.time_split(df, [schema.TEST_DAY])
    fitted = models.train_per_group(
        split.filter(F.col("split") == "train").drop("split"), group,
        lambda pooled: boosted_parts(rounds=rounds, depth=depth, target=[
            "manufacturer", *([group] if pooled else [])]), min_rows)
    test = split.filter(F.col("split") == "test").drop("split")
    scored = fitted.score(test).select(
        F.coalesce(F.col(group).cast("string"), F.lit("(none)")).alias(group), "pooled",
        F.col("order").alias("label"), "score")
    return evaluate.binary_report(scored, 0.5, [group, "pooled"])
