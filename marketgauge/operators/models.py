"""MLlib models: preparation, training, tuning, calibration and explanation."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassificationModel,
                                       GBTClassifier, LogisticRegression, OneVsRest,
                                       OneVsRestModel, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import (ROWS_PER_TASK, checked_broadcast, cut, cut_counted, cut_dealt,
                       run_folder)
from . import boosting, evaluate, isotonic
from .boosting import Boosted
from .cleaning import modes
from .encoders import (INFREQUENT, TargetTable, frequent_levels, spline_basis, spline_ends,
                       target_encode_cv, target_table)
from .joins import lookup
from .ordered import dense_codes
from .sampling import ROW_KEY, hash_ranks, random_sample
from .staged import staged_classes, staged_log_loss, staged_scores

MAX_LEVELS = 1000
MAX_DENSE = 64  # 0/1 places of a row that are written one by one
DEEPEST = 30  # the deepest tree of MLlib
# Labelled rows that each forest of `model_calibrated` is fitted on, at most; all rows are scored.
FIT_ROWS = 5_000
# Fits that run at the same time.
PARALLEL = 8
# Rows of all fits that run at the same time. Boosting keeps some 300 bytes a row in storage.
ROWS_AT_ONCE = 4_000_000


# ---- weights and trivial baselines ----


def class_weights(df: DataFrame, label: str, alpha: float = 1.0,
                  normalise: bool = True) -> DataFrame:
    """(label, n, weight): (rows / (classes x n)) ^ alpha, divided by its mean over classes.
    alpha 1 without `normalise` is the balanced weight, alpha 0 no weighting. A missing label is
    no class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("k"))
                       .alias("t")).scalar()
    raw = F.pow(total.getField("rows") / (total.getField("k") * F.col("n")), F.lit(alpha))
    weighted = counts.withColumn("weight", raw)
    if not normalise:
        return weighted
    mean = weighted.agg(F.avg("weight").alias("m")).scalar()
    return weighted.withColumn("weight", F.col("weight") / mean)


def with_class_weight(df: DataFrame, label: str, alpha: float = 1.0,
                      normalise: bool = False) -> DataFrame:
    """Adds `weight` by class; there is one weight row per class. Rows without a label weigh 0;
    `fit` leaves them out."""
    weights = {r[label]: r["weight"]
               for r in class_weights(df, label, alpha, normalise).collect()}
    weight = F.lit(0.0)
    for value, w in weights.items():
        weight = F.when(F.col(label) == value, w).otherwise(weight)
    return df.withColumn("weight", weight)


def positive_ratio(df: DataFrame, label: str) -> float:
    """Negatives per positive, the usual weight of the positive class."""
    row = df.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
    return (row.n - row.p) / row.p


def baseline_majority(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Predicts the most frequent train label everywhere (ties: the smaller label)."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by(label, F.struct(-F.col("n"), label)).alias("v")).scalar()
    return df.withColumn("prediction", top)


def baseline_mean(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Predicts the train mean everywhere."""
    return df.withColumn("prediction", train.agg(F.avg(label).alias("m")).scalar())


# ---- preparation ----


SPLINE_KNOTS, SPLINE_DEGREE = 5, 3


@dataclass
class Preprocessor:
    """Fills, encodes and assembles the routed columns into `features`.

    Input columns stay as they are; prepared numbers live in `x_<column>` until assembled.
    """

    numeric: Sequence[str] = ()
    one_hot: Sequence[str] = ()
    target: Sequence[str] = ()
    splines: Sequence[str] = ()
    label: str = "label"
    min_frequency: float = 10
    scale: bool = False
    flags: bool = False
    names: list[str] = field(default_factory=list)
    described: dict = field(default_factory=dict, repr=False)
    _train: DataFrame | None = field(default=None, repr=False)
    _medians: dict[str, float] = field(default_factory=dict)
    _modes: dict[str, str] = field(default_factory=dict)
    _levels: dict[str, list[str]] = field(default_factory=dict)
    _tables: dict[str, tuple[DataFrame, int]] = field(default_factory=dict, repr=False)
    _moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    _ends: dict[str, tuple[float, float]] = field(default_factory=dict)
    _encoding: TargetTable | None = field(default=None, repr=False)
    _assembler: PipelineModel | None = field(default=None, repr=False)

    def fit(self, train: DataFrame) -> "Preprocessor":
        self._train = train
        numbers = [*self.numeric, *self.splines]
        if numbers:
            # Fill values: a median within 1e-4 of the rank, one pass and no shuffle of values.
            row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c)
                              for c in numbers]).first()
            self._medians = {c: row[c] for c in numbers if row[c] is not None}
        if self.one_hot:
            self._modes = modes(train, self.one_hot)
        for c in self.one_hot:
            frequent = frequent_levels(train, c, self.min_frequency)
            kept = [r.value for r in frequent.limit(MAX_LEVELS + 1).collect()]
            if len(kept) > MAX_LEVELS:
                # Too many for an expression: a written table of level numbers is joined instead.
                self._tables[c] = cut_counted(dense_codes(frequent, ["value"]).select(
                    F.col("value").alias(f"v_{c}"), F.col("code").alias(f"c_{c}")))
            else:
                self._levels[c] = [*sorted(kept), INFREQUENT]
        if self.target:
            self._encoding = target_table(train, self.target, self.label)
        if self.splines:
            self._ends = spline_ends(self._fill(train), [f"x_{c}" for c in self.splines])
        if self.scale and self.numeric:
            row = self._fill(train).agg(*[
                F.struct(F.avg(f"x_{c}").alias("m"), F.stddev_pop(f"x_{c}").alias("s")).alias(c)
                for c in self.numeric]).first()
            self._moments = {f"x_{c}": (row[c].m, row[c].s or 1.0) for c in self.numeric}
        columns = self._columns()
        stages = []
        for c in self.one_hot:
            if c in self._levels:
                stages.append(StringIndexerModel.from_labels(
                    self._levels[c], inputCol=f"x_{c}", outputCol=f"i_{c}", handleInvalid="error"))
            stages.append(OneHotEncoder(inputCol=f"i_{c}", outputCol=f"h_{c}", dropLast=False))
        hot = [f"h_{c}" for c in self.one_hot]
        stages.append(VectorAssembler(inputCols=[*columns, *hot], outputCol="features"))
        # The stages learn nothing from rows: sizes come from the fixed labels.
        probe = self._prepare(train.limit(1).withColumns(
            {f"{c}_te": F.lit(0.0) for c in self.target}))
        probe = probe.withColumns({f"i_{c}": F.lit(float(n)) for c, (_, n) in self._tables.items()})
        self._assembler = Pipeline(stages=stages).fit(probe)
        # What models are told of the places: 0/1 places of levels are binary.
        self.described = (self._assembler.transform(probe).schema["features"].metadata
                           if self.one_hot else {})
        self.names = [c.removeprefix("x_") for c in columns]
        for c in self.one_hot:
            # As many names as the vector has places.
            self.names += [f"{c}={v}" for v in self._levels.get(c) or [*[
                r[0] for r in self._tables[c][0].orderBy(f"c_{c}").select(f"v_{c}").collect()],
                INFREQUENT]]
        return self

    def _columns(self) -> list[str]:
        flagged = [f"x_{c}_missing" for c in self.numeric] if self.flags else []
        pieces = SPLINE_KNOTS + SPLINE_DEGREE - 2
        spline = [f"x_{c}_sp{i}" for c in self.splines for i in range(pieces)]
        return [*[f"x_{c}" for c in self.numeric], *flagged, *spline,
                *[f"{c}_te" for c in self.target]]

    def places_of(self) -> dict[str, list[int]]:
        """The places of the fitted vector that are made of each input column."""
        made = [[*self.numeric], [*self.numeric] if self.flags else [],
                [c for c in self.splines for _ in range(SPLINE_KNOTS + SPLINE_DEGREE - 2)],
                [*self.target],
                [c for c in self.one_hot for _ in range(
                    len(self._levels[c]) if c in self._levels else self._tables[c][1] + 1)]]
        found: dict[str, list[int]] = {}
        for i, c in enumerate(c for part in made for c in part):
            found.setdefault(c, []).append(i)
        return found

    def _fill(self, df: DataFrame) -> DataFrame:
        filled = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self._medians.get(c, 0.0)))
                  for c in [*self.numeric, *self.splines]}
        if self.flags:
            filled |= {f"x_{c}_missing": F.col(c).isNull().cast("double") for c in self.numeric}
        return df.withColumns(filled) if filled else df

    def _prepare(self, df: DataFrame) -> DataFrame:
        """`df` carries its target encodings already."""
        out = self._fill(df)
        if self.splines:
            out = spline_basis(out, list(self._ends), SPLINE_KNOTS, SPLINE_DEGREE, self._ends)
        made: dict[str, Column] = {c: (F.col(c) - m) / s for c, (m, s) in self._moments.items()}
        for c in self.one_hot:
            value = F.coalesce(F.col(c).cast("string"), F.lit(self._modes.get(c, INFREQUENT)))
            if c in self._tables:
                table, n = self._tables[c]
                out = lookup(out.withColumn(f"v_{c}", value), table, [f"v_{c}"], stored=True)
                made[f"i_{c}"] = F.coalesce(f"c_{c}", F.lit(n)).cast("double")
                continue
            made[f"x_{c}"] = F.when(value.isin(self._levels[c]), value).otherwise(INFREQUENT)
        return out.withColumns(made) if made else out

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = self._encoding.apply(df) if self._encoding else df
        return self._assemble(encoded, df.columns)

    def transform_train(self, fold: Column, some: DataFrame | None = None) -> DataFrame:
        """The fitted table itself, target-encoded from the other folds, or `some` of its rows."""
        rows = self._train if some is None else some
        encoded = target_encode_cv(self._train, self.target, self.label, fold, rows) \
            if self.target else rows
        return self._assemble(encoded, rows.columns)

    def _places(self) -> list[Column] | None:
        """The vector place by place, or None if a column has too many levels for it."""
        if self._tables or sum(map(len, self._levels.values())) > MAX_DENSE:
            return None
        hot = [(F.col(f"x_{c}") == v).cast("double") for c in self.one_hot for v in self._levels[c]]
        return [*[F.col(c).cast("double") for c in self._columns()], *hot]

    def _assemble(self, encoded: DataFrame, columns: Sequence[str]) -> DataFrame:
        out, places = self._prepare(encoded), self._places()
        if places is None:
            out = self._assembler.transform(out)
            return out.select(*columns, "features")
        # One array in the row's own code instead of a function call for each column. Trees ask for
        # one place at a time, which a sparse vector searches for.
        known = F.lit(True)
        for c in self._columns():
            known = known & F.col(c).isNotNull() & ~F.isnan(c)
        values = F.when(known, F.array(*places)).otherwise(
            F.raise_error(F.lit("a model input is NULL or NaN")))
        return out.select(*columns, array_to_vector(values).alias(
            "features", metadata=self.described))


def row_fold(k: int = 5, keys: Sequence[str] = ROW_KEY, seed: int = 7) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)).cast("int")


@dataclass
class Trained:
    """A fitted model with the preparation it was trained on."""

    preprocessor: Preprocessor
    model: Model
    seconds: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.preprocessor.transform(df))

    def score(self, df: DataFrame, cls: int = 1) -> DataFrame:
        """Adds `score`, the probability of class `cls`."""
        return self.score_prepared(self.preprocessor.transform(df), cls)

    def score_prepared(self, prepared: DataFrame, cls: int = 1) -> DataFrame:
        """As `score`, of rows that have their `features`."""
        out = self.model.transform(prepared)
        return out.withColumn("score", vector_to_array("probability")[cls])


def _read_by(estimator) -> list[str]:
    """The columns that a fit reads."""
    names = ("featuresCol", "labelCol", "weightCol", "validationIndicatorCol")
    asked = [estimator.getOrDefault(n) for n in names
             if estimator.hasParam(n) and estimator.isDefined(n)]
    return list(dict.fromkeys(c for c in asked if c))


def fit(train: DataFrame, estimator, preprocessor: Preprocessor,
        fold: Column | None = None, valid: DataFrame | None = None) -> Trained:
    """Prepares the train rows once, writes what the fit reads of them (vectors, labels, weights),
    and fits on that. Rows without a label are left out.

    With `valid` the estimator sees those rows as well, marked in `is_valid`, to stop early. The
    preparation learns from the train rows alone: a validation row is filled and encoded as a new
    row, never from its own label.
    """
    start = time.time()
    labelled = F.col(preprocessor.label).isNotNull()
    preprocessor.fit(train.filter(labelled))
    fold = row_fold() if fold is None else fold
    prepared = preprocessor.transform_train(fold)
    if valid is not None:
        checked = preprocessor.transform(valid.filter(labelled))
        prepared = prepared.withColumn("is_valid", F.lit(False)).unionByName(
            checked.withColumn("is_valid", F.lit(True)))
    rows, n = cut_counted(prepared.select(*_read_by(estimator)))
    if isinstance(estimator, OneVsRest):
        estimator = one_by_one(estimator, n)
    model = estimator.fit(rows)
    if isinstance(model, RandomForestClassificationModel):
        # A forest's training summary holds on to its frame and cannot be sent to tasks.
        model = model.copy()
    return Trained(preprocessor, model, time.time() - start)


# ---- the models in use ----


def logistic(label: str = "label", weight: str | None = "weight", **params):
    chosen = dict(labelCol=label, family="multinomial", maxIter=200) | params
    if weight:
        chosen["weightCol"] = weight
    return LogisticRegression(**chosen)


def tree(label: str = "label", weight: str | None = "weight", depth: int = 5,
         min_leaf: int = 50, **params):
    chosen = dict(labelCol=label, maxDepth=depth, minInstancesPerNode=min_leaf, seed=42) | params
    if weight:
        chosen["weightCol"] = weight
    return DecisionTreeClassifier(**chosen)


class Forest(RandomForestClassifier):
    """The training summary of a forest holds on to its frame, which cannot be sent to tasks: the
    model is kept without it."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        return super()._fit(dataset).copy()


def forest(label: str = "label", weight: str | None = "weight", trees: int = 100,
           depth: int = 30, min_leaf: int = 10, **params):
    chosen = dict(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                  featureSubsetStrategy="sqrt", cacheNodeIds=True, seed=42) | params
    # Without the cached ids each step sends the whole forest to each task.
    if weight:
        chosen["weightCol"] = weight
    return Forest(**chosen)


def boosted(label: str = "label", weight: str | None = "weight", rounds: int = 100,
            depth: int = 6, rate: float = 0.1, **params):
    chosen = dict(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate,
                  seed=42) | params
    if weight:
        chosen["weightCol"] = weight
    return Boosted(**chosen)


def quantity_classifier(label: str = "label", weight: str = "weight", **params):
    """Boosted trees one class against the rest (MLlib boosting is two-class)."""
    return ClassModels(classifier=boosted(label, None, **params), labelCol=label,
                       weightCol=weight, parallelism=PARALLEL)


class ClassModels(OneVsRest):
    """One class against the rest; boosted class models share the rows they are fitted on."""

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        found = fit_class_models(dataset, [self])
        return super()._fit(dataset) if found is None else found[0]


def class_fits(estimators: Sequence[OneVsRest], classes: int
               ) -> tuple[list[GBTClassifier], list[float]] | None:
    """The fits of all class models, one after the other, and the class of each; None if they are
    not boosted trees."""
    if not all(isinstance(e, OneVsRest) and isinstance(e.getClassifier(), Boosted)
               for e in estimators):
        return None
    fits, positive = [], []
    for e in estimators:
        inner = e.getClassifier()
        asked = {inner.labelCol: e.getLabelCol(), inner.featuresCol: e.getFeaturesCol()}
        if e.isDefined("weightCol") and e.getWeightCol():
            asked[inner.weightCol] = e.getWeightCol()
        fits += [inner.copy(asked) for _ in range(classes)]
        positive += [float(c) for c in range(classes)]
    return fits, positive


def fit_class_models(rows: DataFrame, estimators: Sequence[OneVsRest]
                     ) -> list[OneVsRestModel] | None:
    """The models of all estimators on the same rows, all class models in one call; None where they
    are not for that."""
    label = estimators[0].getLabelCol()
    top = rows.agg(F.max(label)).first()[0]
    classes = 0 if top is None else int(top) + 1
    made = class_fits(estimators, classes) if classes > 1 else None
    fitted = boosting.fit_all(rows, *made) if made else None
    if fitted is None:
        return None
    out = []
    for i, e in enumerate(estimators):
        model = OneVsRestModel(models=fitted[i * classes:(i + 1) * classes])
        model._resetUid(e.uid)
        out.append(e._copyValues(model))
    return out


def at_once(rows: int, parallel: int = PARALLEL) -> int:
    """Fits to run at the same time, of `rows` rows each. Every fit keeps its binned rows and
    residuals in storage: too many push each other's out to disk, and each step reads them back. A
    fit of many rows keeps all cores busy alone."""
    return max(1, min(parallel, ROWS_AT_ONCE // max(1, rows)))


def one_by_one(estimator: OneVsRest, rows: int) -> OneVsRest:
    """The estimator, with as many class models at the same time as `rows` rows allow."""
    return estimator.copy({estimator.parallelism: at_once(rows, estimator.getParallelism())})


def quantity_tree(label: str = "label", depth: int = 5):
    return DecisionTreeRegressor(labelCol=label, maxDepth=depth, seed=42)


@dataclass
class GroupModels:
    """A model for each large group, and one for all small groups together."""

    group: str
    own: Mapping[str, Trained]
    pooled: Trained | None

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `score` (probability of class 1) and `pooled`. Groups without a model of their own,
        unseen ones and NULL, go to the pooled model; there is no score if there is none."""
        known = F.col(self.group).cast("string")
        mine = F.when(known.isin(list(self.own)), known)
        spread = cut(df.withColumn("_model", F.coalesce(mine, F.lit(""))))
        columns = [*df.columns, "score", "pooled"]
        rest = spread.filter(F.col("_model") == "")
        if self.pooled:
            out = self.pooled.score(rest)
        else:
            out = rest.withColumn("score", F.lit(None).cast("double"))
        out = out.withColumn("pooled", F.lit(True)).select(*columns)
        for value, trained in self.own.items():
            part = trained.score(spread.filter(F.col("_model") == value))
            out = out.unionByName(part.withColumn("pooled", F.lit(False)).select(*columns))
        return out


def train_per_group(df: DataFrame, group: str, make: Callable[..., tuple], min_rows: int = 1000,
                    max_models: int = 1000, fit_rows: int | None = None,
                    parallel: int = PARALLEL) -> GroupModels:
    """One model for each group of at least `min_rows` rows with a label and both labels among
    them, the group column left out; all other rows, NULL groups too, train one pooled model that
    has the group as a target-encoded input. `make(pooled)` gives estimator and preparation.

    A group must also hold 1 / `max_models` of the rows, which bounds the models whatever the
    number of groups. Rows are written once, a folder for each model, and each fit reads its own
    folder; fits of few rows run at the same time (`at_once`).
    """
    label = make(False)[1].label
    rows = df.filter(F.col(label).isNotNull()).withColumn(group, F.col(group).cast("string"))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"),
                                     F.count_distinct(label).alias("labels"))
    total = rows.count()
    large = counts.filter(F.col(group).isNotNull() & (F.col("n") >= min_rows)
                          & (F.col("n") * max_models >= total) & (F.col("labels") > 1))
    sizes = {r[group]: r.n for r in large.collect()}
    values = sorted(sizes)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(group)), F.lit(0)) \
        if values else F.lit(0)
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    placed = rows.withColumn("_model", place.cast("int"))
    placed.write.partitionBy("_model").parquet(path)
    stored = df.sparkSession.read.schema(placed.schema).parquet(path)

    def fitted(number: int) -> Trained | None:
        own = stored.filter(F.col("_model") == number).drop("_model", *([group] if number else []))
        if not number and own.select(label).distinct().limit(2).count() < 2:
            return None
        estimator, preprocessor = make(not number)
        start = time.time()
        preprocessor.fit(own)
        model = estimator.fit(fitting_rows(preprocessor.transform_train(row_fold()), fit_rows))
        return Trained(preprocessor, model, time.time() - start)

    # The pooled model first.
    numbers = [total - sum(sizes.values()), *[sizes[v] for v in values]]
    found = concurrently_by_rows(fitted, numbers if fit_rows is None else [
        min(n, fit_rows) for n in numbers], parallel)
    return GroupModels(group, dict(zip(values, found[1:])), found[0])


# ---- tuning ----


def _report(spark, rows: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([Row(**r) for r in rows])


def fitting_rows(prepared: DataFrame, most: int | None = FIT_ROWS,
                 keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """The written rows that a fit reads: exactly `most` of them, by a hash of their key, if there
    are more. Small tables are put into few partitions: each step of a tree fit exchanges
    statistics of every node from each partition."""
    rows, n = cut_counted(prepared)
    if most is not None and n > most:
        rows, n = cut_counted(random_sample(rows, most, keys))
    return rows.coalesce(max(1, n // ROWS_PER_TASK))


def some_fitting_rows(preprocessor: Preprocessor, most: int | None = FIT_ROWS,
                      keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """The rows of `fitting_rows` of all prepared train rows: chosen first, so that no others are
    prepared and written. Encodings are learned from all."""
    train = preprocessor._train
    if most is None or train.count() <= most:
        return fitting_rows(preprocessor.transform_train(row_fold()), most, keys)
    some = cut(random_sample(train, most, keys))
    return fitting_rows(preprocessor.transform_train(row_fold(), some), most, keys)


def concurrently(work: Callable, tasks: Sequence, parallel: int = PARALLEL) -> list:
    """`work` for each task from several threads, in the order of the tasks: jobs of small fits
    leave most cores idle. Local properties of the caller (its pool) hold in the threads."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
        return pool.map(inherit(work), tasks, chunksize=1)


def concurrently_by_rows(work: Callable[[int], object], rows: Sequence[int],
                         parallel: int = PARALLEL) -> list:
    """`work` for the number of each task, in their order, with its rows in `rows`: large tasks one
    by one, smaller ones as many at the same time as `at_once` tells for their size."""
    widths = [at_once(n, parallel) for n in rows]
    found = {}
    for width in sorted(set(widths)):
        tasks = [i for i, w in enumerate(widths) if w == width]
        found |= zip(tasks, concurrently(work, tasks, width))
    return [found[i] for i in range(len(rows))]


def _fit_size(train: DataFrame, most: int | None) -> int:
    """Rows that a fit reads, at most."""
    return train.count() if most is None else most


def _prepared(train: DataFrame, others: DataFrame, preprocessor: Preprocessor,
              most: int | None) -> tuple[DataFrame, DataFrame]:
    """Written vectors of the rows to fit on, and of the rows to score."""
    preprocessor.fit(train.filter(F.col(preprocessor.label).isNotNull()))
    return some_fitting_rows(preprocessor, most), cut_dealt(preprocessor.transform(others))[0]


def _one_fit(estimator, preprocessor: Preprocessor) -> str:
    """Forests that differ in their trees alone are one fit."""
    settings = {p.name: str(v) for p, v in estimator.extractParamMap().items()}
    if isinstance(estimator, RandomForestClassifier):
        del settings["numTrees"]
    return repr((type(estimator).__name__, sorted(settings.items()), preprocessor))


def tune_grid(df: DataFrame, label: str, grid: Sequence[Mapping], make: Callable[..., tuple],
              fold: str = "fold", fit_rows: int | None = None,
              parallel: int = PARALLEL) -> DataFrame:
    """Cross-validated grid: mean train and test ROC-AUC and F1, gap, fit time, rank.

    Preparation is fitted once for each fold and each different setting of it, on the other
    folds' rows. Cells that differ only in the number of trees are scored from the largest of
    their forests: the first 100 trees of 300 are a forest of 100 (not the one MLlib draws for
    100, whose rows are drawn in another order). Fits run at the same time where rows are few, on
    all prepared rows, or on `fit_rows` of them at most; all rows are scored. Only metric rows come back to the
    driver.
    """
    spark = df.sparkSession
    folds = sorted(r[fold] for r in df.select(fold).distinct().collect())
    fits: dict[str, list[int]] = {}
    for i, params in enumerate(grid):
        fits.setdefault(_one_fit(*make(**params)), []).append(i)
    cells = list(fits.values())
    settings = {repr(make(**p)[1]): p for p in grid}

    def prepare(task: tuple) -> tuple[DataFrame, DataFrame]:
        f, setting = task
        preprocessor = make(**settings[setting])[1]
        return _prepared(df.filter(F.col(fold) != f), df, preprocessor, fit_rows)

    parallel = at_once(_fit_size(df, fit_rows), parallel)
    parts = [(f, setting) for f in folds for setting in settings]
    ready = dict(zip(parts, concurrently(prepare, parts, parallel)))

    def fitted(task: tuple) -> tuple[list[int], float, DataFrame]:
        f, k = task
        made = [make(**grid[i]) for i in cells[k]]
        train, every = ready[f, repr(made[0][1])]
        every = every.select(fold, F.col(label).alias("label"), "features")
        forest_ = isinstance(made[0][0], RandomForestClassifier)
        trees = [e.getNumTrees() if forest_ else 1 for e, _ in made]
        estimator = made[trees.index(max(trees))][0]
        start = time.time()
        model = estimator.fit(train)
        secs = time.time() - start
        stages = sorted(set(trees))
        if forest_:
            # A forest's training summary holds on to its frame and cannot be sent to tasks.
            scored = staged_scores(spark, model.copy(), every, stages)
        else:
            scored = model.transform(every).withColumn(
                "scores", F.array(vector_to_array("probability")[1]))
        places = [stages.index(t) for t in trees]
        return places, secs, scored.select(
            F.lit(f).alias("tested"), F.lit(k).alias("fit"), "label",
            F.when(F.col(fold) == f, "test").otherwise("train").alias("side"),
            F.posexplode("scores").alias("stage", "score"))

    tasks = [(f, k) for f in folds for k in range(len(cells))]
    done = dict(zip(tasks, concurrently(fitted, tasks, parallel)))
    frames = [d[2] for d in done.values()]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    report = {(r.tested, r.fit, r.stage, r.side): r for r in evaluate.binary_report(
        cut(every), 0.5, ["tested", "fit", "stage", "side"]).collect()}
    rows = []
    for k, members in enumerate(cells):
        for j, i in enumerate(members):
            side = {s: [report[f, k, done[f, k][0][j], s] for f in folds]
                    for s in ("train", "test")}
            mean = {(s, m): sum(r[m] for r in side[s]) / len(folds)
                    for s in side for m in ("roc_auc", "f1")}
            spread = (sum((r.roc_auc - mean["test", "roc_auc"]) ** 2 for r in side["test"])
                      / len(folds)) ** 0.5
            rows.append({
                "cell": i, "params": str(dict(grid[i])),
                "mean_train_auc": mean["train", "roc_auc"],
                "mean_test_auc": mean["test", "roc_auc"], "std_test_auc": spread,
                "mean_train_f1": mean["train", "f1"], "mean_test_f1": mean["test", "f1"],
                "gap": mean["train", "roc_auc"] - mean["test", "roc_auc"],
                "fit_seconds": sum(done[f, k][1] for f in folds) / len(folds)})
    rows.sort(key=lambda r: (-r["mean_test_auc"], r["cell"]))
    return _report(spark, [r | {"rank": n} for n, r in enumerate(rows, start=1)])


def random_params(space: Mapping[str, Sequence], trials: int, seed: int = 42) -> list[dict]:
    draw = random.Random(seed)
    return [{k: draw.choice(list(v)) for k, v in space.items()} for _ in range(trials)]


def _scored(model: Model, prepared: DataFrame, label: str, cls: int = 1) -> DataFrame:
    """(label, score) of prepared rows."""
    if isinstance(model, RandomForestClassificationModel):
        model = model.copy()
    return model.transform(prepared).select(
        F.col(label).alias("label"), vector_to_array("probability")[cls].alias("score"))


def best_round(spark, model: Model, prepared: DataFrame, label: str) -> tuple[int, DataFrame]:
    """The number of first trees of a boosted model with the least log-loss on the rows (of equals
    the smallest), and (label, score) of the rows after that many."""
    rounds = model.getNumTrees
    staged = staged_scores(spark, model, prepared.select(label, "features"),
                           list(range(1, rounds + 1)))
    losses = staged_log_loss(staged, list(range(1, rounds + 1)), label)
    best = losses.orderBy(F.round("log_loss", 12), "stage").first().stage
    return best, staged.select(F.col(label).alias("label"),
                               F.get("scores", F.lit(best - 1)).alias("score"))


def _fit_together(made: Sequence[tuple], ready: Mapping[str, tuple]) -> dict[int, Model]:
    """The models of boosted trials by number, all those on the same rows in one call."""
    found: dict[int, Model] = {}
    for setting, (rows, *_) in ready.items():
        mine = [i for i, (e, p) in enumerate(made) if repr(p) == setting and isinstance(e, Boosted)]
        models_ = boosting.fit_all(rows, [made[i][0] for i in mine]) if mine else None
        found |= dict(zip(mine, models_ or []))
    return found


def tune_random(train: DataFrame, valid: DataFrame, label: str, params: Sequence[Mapping],
                make: Callable[..., tuple], fit_rows: int | None = None,
                parallel: int = PARALLEL) -> tuple[DataFrame, Trained]:
    """Random search scored on the validation rows by PR-AUC, and the best setting refitted on all
    rows of train and validation together.

    A boosted trial is fitted once, for all its rounds; its staged scores on the validation rows
    tell the round of least log-loss, which is what stopping there would have left, and the refit
    has that many rounds. Preparation is made once for each different setting of it and never sees
    validation labels. Trials are fitted on all rows, or on `fit_rows` of them at most; boosted ones
    share rows that are cut into bins once.
    """
    spark = train.sparkSession
    valid = valid.filter(F.col(label).isNotNull())
    settings = {repr(make(**p)[1]): p for p in params}
    ready = {s: _prepared(train, valid, make(**p)[1], fit_rows) for s, p in settings.items()}

    together = _fit_together([make(**p) for p in params], ready)

    def trial(i: int) -> dict:
        estimator, preprocessor = make(**params[i])
        rows, checked = ready[repr(preprocessor)]
        start = time.time()
        model = together.get(i) or estimator.fit(rows)
        seconds = model.seconds if i in together else time.time() - start
        if isinstance(model, GBTClassificationModel):
            trees, scored = best_round(spark, model, checked, label)
        else:
            trees = model.getNumTrees if hasattr(model, "getNumTrees") else 0
            scored = _scored(model, checked, label)
        r = evaluate.binary_report(scored, 0.5).first()
        return {"trial": i, "params": str(dict(params[i])), "best_iter": trees,
                "valid_roc_auc": r.roc_auc, "valid_pr_auc": r.pr_auc, "valid_f1": r.f1,
                "seconds": seconds}

    rows = concurrently(trial, range(len(params)), at_once(_fit_size(train, fit_rows), parallel))
    best = max(rows, key=lambda r: (r["valid_pr_auc"], -r["trial"]))
    estimator, preprocessor = make(**params[best["trial"]])
    if isinstance(estimator, GBTClassifier):
        estimator = estimator.copy({estimator.maxIter: best["best_iter"]})
    return _report(spark, rows), fit(train.unionByName(valid), estimator, preprocessor)


def _weighted_models(train: DataFrame, others: Sequence[DataFrame], weights: Mapping[str, Column],
                     make: Callable[[], tuple], parallel: int
                     ) -> tuple[dict[str, Trained], list[DataFrame]]:
    """A model for each weighting, fitted on rows that are prepared once (few rows: at the same
    time), and the other tables prepared."""
    estimator, preprocessor = make()
    names = {n: f"_weight_{i}" for i, n in enumerate(weights)}
    rows = train.withColumns({names[n]: w for n, w in weights.items()})
    preprocessor.fit(rows.filter(F.col(preprocessor.label).isNotNull()))
    prepared = fitting_rows(preprocessor.transform_train(row_fold()), None)
    parallel = at_once(prepared.count(), parallel)

    def fitted(name: str) -> Trained:
        start = time.time()
        chosen = estimator.copy({estimator.getParam("weightCol"): names[name]})
        return Trained(preprocessor, chosen.fit(prepared), time.time() - start)

    models_ = None
    if isinstance(estimator, Boosted):
        models_ = boosting.fit_all(prepared, [
            estimator.copy({estimator.weightCol: names[n]}) for n in weights])
    if models_ is None:
        trained = dict(zip(weights, concurrently(fitted, list(weights), parallel)))
    else:
        trained = {n: Trained(preprocessor, m, m.seconds) for n, m in zip(weights, models_)}
    return trained, [cut(preprocessor.transform(o)) for o in others]


def sweep_weights(train: DataFrame, test: DataFrame, label: str, weights: Mapping[str, Column],
                  make: Callable[[], tuple], parallel: int = PARALLEL) -> DataFrame:
    """One fit per weighting on rows that are prepared once; ranking and threshold metrics, best
    PR-AUC first. The estimator of `make` takes weights."""
    trained, (checked,) = _weighted_models(train, [test], weights, make, parallel)

    def row(name: str) -> dict:
        r = evaluate.binary_report(_scored(trained[name].model, checked, label), 0.5).first()
        return {"weighting": name, "roc_auc": r.roc_auc, "pr_auc": r.pr_auc,
                "precision": r.precision, "recall": r.recall, "f1": r.f1}

    rows = concurrently(row, list(weights), parallel)
    rows.sort(key=lambda r: (-r["pr_auc"], r["weighting"]))
    return _report(train.sparkSession, rows)


def class_names(labels: Sequence[str]) -> Callable[[Column], Column]:
    """From a class number to its name."""
    names = F.array(*map(F.lit, labels))
    return lambda number: F.element_at(names, number.cast("int") + 1)


def multiclass_report(trained: Trained, df: DataFrame, label: str,
                      labels: Sequence[str]) -> DataFrame:
    name = class_names(labels)
    rows = trained.predict(df).select(name(F.col(label)).alias("label"),
                                      name(F.col("prediction")).alias("prediction"))
    return evaluate.multiclass_metrics(rows, labels)


def _class_metrics(predicted: DataFrame, label: str, labels: Sequence[str]) -> Row:
    """Accuracy and macro-F1 of rows with class numbers in `label` and `prediction`."""
    name = class_names(labels)
    rows = predicted.select(name(F.col(label)).alias("label"),
                            name(F.col("prediction")).alias("prediction"))
    return evaluate.multiclass_metrics(rows, labels).first()


def sweep_alphas(train: DataFrame, test: DataFrame, label: str, alphas: Sequence[float],
                 labels: Sequence[str], make: Callable[[], tuple],
                 parallel: int = PARALLEL) -> DataFrame:
    """One fit for each strength of class weighting, on rows that are prepared once; accuracy and
    macro-F1, best macro-F1 first. `label` numbers the classes of `labels`; alpha 0 weighs all
    rows alike, 1 all classes."""
    estimator, preprocessor = make()
    weighted = train
    for i, alpha in enumerate(alphas):
        weighted = with_class_weight(weighted, label, alpha, normalise=True).withColumnRenamed(
            "weight", f"_weight_{i}")
    rows, checked = _prepared(weighted, test, preprocessor, None)
    # Class models of all strengths count together.
    n = rows.count()
    if isinstance(estimator, OneVsRest):
        estimator = one_by_one(estimator, n)
        parallel = at_once(n * estimator.getParallelism(), parallel)
    else:
        parallel = at_once(n, parallel)

    chosen = [estimator.copy({estimator.getParam("weightCol"): f"_weight_{i}"})
              for i in range(len(alphas))]
    fitted = fit_class_models(rows, chosen) if isinstance(estimator, ClassModels) else None

    def row(i: int) -> dict:
        model = fitted[i] if fitted else chosen[i].fit(rows)
        r = _class_metrics(model.transform(checked), label, labels)
        return {"alpha": float(alphas[i]), "accuracy": r.accuracy, "macro_f1": r.macro_f1}

    found = concurrently(row, range(len(alphas)), parallel)
    found.sort(key=lambda r: (-round(r["macro_f1"], 9), r["alpha"]))
    return _report(train.sparkSession, found)


def _lone_rows(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key and label no other row has, and written ones that share them, if any."""
    keys = [*ROW_KEY, label]
    often, n = cut_counted(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
                           .select(*[F.col(c).alias(f"_{c}") for c in keys]))
    if not n:
        return rows, None
    often = checked_broadcast(often)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return cut(rows.join(often, same, "left_anti")), cut(rows.join(often, same, "left_semi"))


def _by_key(spark: SparkSession, fitted: Sequence[Model], rows: DataFrame, label: str,
            rounds: Sequence[int]) -> DataFrame:
    """(label, stage, prediction): rows of one key and label count once, by the surest of their
    class scores, of equals the first class."""
    every = None
    for cls, model in enumerate(fitted):
        part = staged_scores(spark, model, rows, rounds).withColumn("_cls", F.lit(cls))
        every = part if every is None else every.unionByName(part)
    stages = every.select(*ROW_KEY, label, "_cls", F.posexplode("scores").alias("stage", "p"))
    return stages.groupBy(*ROW_KEY, label, "stage").agg(
        F.min_by("_cls", F.struct(-F.col("p"), "_cls")).alias("prediction")).select(
            label, "stage", "prediction")


def tune_multiclass(train: DataFrame, valid: DataFrame, label: str, labels: Sequence[str],
                    params: Sequence[Mapping], make: Callable[..., tuple],
                    fit_rows: int | None = None, parallel: int = PARALLEL
                    ) -> tuple[DataFrame, Trained]:
    """Random search over class models of boosted trees one against the rest, ranked by macro-F1 on
    the validation rows, and the best setting refitted on train and validation together.

    All trees of a trial are fitted once. Staged scores of its class models give, after each
    round, the class of highest margin; the round of highest macro-F1 (of equals the smallest)
    stands for the trial, and the refit has that many. Class models of all trials are fitted
    together, on all rows or on `fit_rows` of them at most; preparation is made once for each setting
    of it.
    """
    spark = train.sparkSession
    settings = {repr(make(**p)[1]): p for p in params}
    ready = {}
    for s, p in settings.items():
        rows, checked = _prepared(train, valid, make(**p)[1], fit_rows)
        ready[s] = rows, *_lone_rows(checked.select(*ROW_KEY, label, "features"), label)
    classes = range(len(labels))

    def one_class(task: tuple[int, int]) -> tuple[float, Model]:
        i, cls = task
        estimator, preprocessor = make(**params[i])
        rows = ready[repr(preprocessor)][0]
        against = F.when(F.col(label) == cls, 1.0).otherwise(0.0)
        chosen = estimator.getClassifier().copy()
        chosen = chosen.copy({chosen.getParam("labelCol"): "_is",
                              chosen.getParam("weightCol"): estimator.getWeightCol()})
        start = time.time()
        model = chosen.fit(rows.withColumn("_is", against))
        return time.time() - start, model

    made = [make(**p) for p in params]
    done: dict[tuple[int, int], tuple[float, Model]] = {}
    for setting, (rows, *_) in ready.items():
        mine = [i for i, (_, p) in enumerate(made) if repr(p) == setting]
        fits = class_fits([made[i][0] for i in mine], len(labels))
        fitted = boosting.fit_all(rows, *fits) if fits else None
        if fitted:
            done |= {(i, c): (m.seconds, m) for (i, c), m in zip(
                [(i, c) for i in mine for c in classes], fitted)}
    tasks = [(i, c) for i in range(len(params)) for c in classes if (i, c) not in done]
    if tasks:
        parallel = at_once(_fit_size(train, fit_rows), parallel)
        done |= zip(tasks, concurrently(one_class, tasks, parallel))

    def trial(i: int) -> dict:
        _, lone, shared = ready[repr(make(**params[i])[1])]
        fitted = [done[i, c][1] for c in classes]
        rounds = list(range(1, fitted[0].getNumTrees + 1))
        # Each row tells its class after each round where it stands; counts alone are exchanged.
        predicted = staged_classes(spark, fitted, lone.select(label, "features"), rounds).select(
            label, F.posexplode("classes").alias("stage", "prediction"))
        if shared is not None:
            predicted = predicted.unionByName(_by_key(spark, fitted, shared, label, rounds))
        name = class_names(labels)
        cells = predicted.groupBy("stage", name(F.col(label)).alias("label"), name(
            F.col("prediction")).alias("prediction")).agg(F.count("*").alias("n")).collect()
        found = [(*_macro_f1([c for c in cells if c.stage == s], labels), s + 1)
                 for s in sorted({c.stage for c in cells})]
        f1, accuracy, best = max(found, key=lambda x: (round(x[0], 9), -x[2]))
        return {"trial": i, "params": str(dict(params[i])), "best_iter": best,
                "accuracy": accuracy, "macro_f1": f1,
                "seconds": sum(done[i, c][0] for c in classes)}

    rows = concurrently(trial, range(len(params)))
    rows.sort(key=lambda r: (-round(r["macro_f1"], 9), r["trial"]))
    best = rows[0]
    estimator, preprocessor = make(**params[best["trial"]])
    inner = estimator.getClassifier()
    estimator = estimator.copy({estimator.classifier: inner.copy({inner.maxIter: best["best_iter"]})})
    return (_report(spark, [r | {"rank": n} for n, r in enumerate(rows, start=1)]),
            fit(train.unionByName(valid), estimator, preprocessor))


def _macro_f1(cells: Sequence[Row], labels: Sequence[str]) -> tuple[float, float]:
    """(macro-F1, accuracy) from the cells of a confusion table; a class that is neither there nor
    predicted has F1 0."""
    total = sum(c.n for c in cells)
    scores = []
    for v in labels:
        both = sum(c.n for c in cells if c.label == v and c.prediction == v)
        either = sum(c.n for c in cells if c.label == v) + sum(
            c.n for c in cells if c.prediction == v)
        scores.append(2 * both / either if either else 0.0)
    right = sum(c.n for c in cells if c.label == c.prediction)
    return sum(scores) / len(labels), right / total if total else 0.0


def compare_feature_sets(train: DataFrame, test: DataFrame, label: str,
                         sets: Mapping[str, Sequence[str]], make: Callable[[Sequence[str]], tuple],
                         parallel: int = PARALLEL) -> DataFrame:
    """One fit per feature set, of few rows at the same time; metrics, best PR-AUC first."""
    def row(name: str) -> dict:
        estimator, preprocessor = make(sets[name])
        rows, checked = _prepared(train, test, preprocessor, None)
        r = evaluate.binary_report(_scored(estimator.fit(rows), checked, label), 0.5).first()
        return {"feature_set": name, "n_features": len(sets[name]), "roc_auc": r.roc_auc,
                "pr_auc": r.pr_auc, "precision": r.precision, "recall": r.recall, "f1": r.f1}

    rows = concurrently(row, list(sets), at_once(_fit_size(train, None), parallel))
    rows.sort(key=lambda r: (-r["pr_auc"], r["feature_set"]))
    return _report(train.sparkSession, rows)


def select_bundle(train: DataFrame, valid: DataFrame, test: DataFrame, label: str,
                  weights: Mapping[str, Column], grid: Sequence[float],
                  make: Callable[[], tuple], parallel: int = PARALLEL) -> DataFrame:
    """Weight x threshold search on validation: best PR-AUC, then best F1; one test score. Rows are
    prepared once for all weightings."""
    trained, (checked, tested) = _weighted_models(train, [valid, test], weights, make, parallel)

    def tried(name: str) -> tuple:
        scored = cut(_scored(trained[name].model, checked, label))
        ranked = evaluate.ranking_metrics(scored).first()
        return ranked.pr_auc, evaluate.best_threshold(
            evaluate.threshold_sweep(scored, grid)).first()

    found = dict(zip(weights, concurrently(tried, list(weights), parallel)))
    # Of equals the first weighting.
    name = max(weights, key=lambda n: (found[n][0], found[n][1].f1))
    pr_auc, point = found[name]
    final = _scored(trained[name].model, tested, label)
    return evaluate.binary_report(final, point.threshold).select(
        F.lit(name).alias("weighting"), F.lit(point.threshold).alias("threshold"),
        F.lit(pr_auc).alias("valid_pr_auc"), F.lit(point.f1).alias("valid_f1"), "*")


# ---- calibration ----


@dataclass
class Calibrated:
    """Fold models with an isotonic curve each; the probability is their mean."""

    parts: Sequence[tuple[Trained, DataFrame]]

    def score(self, df: DataFrame) -> DataFrame:
        out, made = df, []
        for i, (trained, curve) in enumerate(self.parts):
            scored = trained.score(out).select(*df.columns, *made, "score")
            made.append(f"_c{i}")
            out = isotonic.apply_isotonic(scored, curve, name=made[-1]).drop("score")
        total = sum((F.col(c) for c in made[1:]), F.col(made[0]))
        return out.withColumn("score", total / len(made)).select(*df.columns, "score")


def calibrate_isotonic(df: DataFrame, label: str, fold: str, make: Callable[[], tuple],
                       fit_rows: int | None = None, parallel: int = PARALLEL) -> Calibrated:
    """Per fold: fit on the other folds (on `fit_rows` of their rows at most, if given), learn the
    isotonic curve on all rows of the held-out one. Folds are fitted at the same time; violators
    are pooled in parts (`isotonic`), not on the driver."""
    def part(f) -> tuple[Trained, DataFrame]:
        estimator, preprocessor = make()
        start = time.time()
        rows, held = _prepared(df.filter(F.col(fold) != f),
                               df.filter((F.col(fold) == f) & F.col(label).isNotNull()),
                               preprocessor, fit_rows)
        model = estimator.fit(rows)
        curve = isotonic.isotonic_blocks(_scored(model, held, label))
        if isinstance(model, RandomForestClassificationModel):
            model = model.copy()
        return Trained(preprocessor, model, time.time() - start), curve

    folds = sorted(r[fold] for r in df.select(fold).distinct().collect())
    return Calibrated(concurrently(part, folds, at_once(_fit_size(df, fit_rows), parallel)))


# ---- explanation ----


def feature_importance(trained: Trained, top: int | None = None) -> DataFrame:
    """Tree importances by feature name, largest first (one row per model input)."""
    spark = trained.preprocessor._train.sparkSession
    values = trained.model.featureImportances.toArray()
    out = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(trained.preprocessor.names, values)],
        "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out if top is None else out.limit(top)


def coefficients(trained: Trained, row: int, top: int = 15) -> DataFrame:
    """The `top` coefficients of one class by absolute size."""
    spark = trained.preprocessor._train.sparkSession
    values = trained.model.coefficientMatrix.toArray()[row]
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(trained.preprocessor.names, values)],
        "feature string, coefficient double").orderBy(
            F.desc(F.abs("coefficient")), "feature").limit(top)


def tree_rules(trained: Trained) -> DataFrame:
    """The decision rules line by line with feature names put in."""
    text = trained.model.toDebugString
    names = trained.preprocessor.names
    for i in range(len(names) - 1, -1, -1):
        text = text.replace(f"(feature {i} ", f"({names[i]} ")
    lines = [(i, line) for i, line in enumerate(text.splitlines())]
    spark = trained.preprocessor._train.sparkSession
    return spark.createDataFrame(lines, "line int, rule string")


ROWS_PER_BUCKET = 200_000


def permuted_rows(df: DataFrame, features: Sequence[str], repeats: int,
                  keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """(columns of df.., _others): for each repeat, in order, a struct of the tested columns of one
    other row. A repeat pairs every row with one other by two hash ranks, a permutation.

    Rows are written once, in buckets of their number. Only ranks, row numbers and the tested
    columns are exchanged; the permuted values come to the buckets, where the rows stay.
    """
    spark = df.sparkSession
    numbered, n = cut_counted(df.withColumn("_row", F.monotonically_increasing_id()))
    name = f"marketgauge_{uuid.uuid4().hex}"
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    (numbered.write.bucketBy(buckets, "_row").sortBy("_row")
     .option("path", f"{run_folder(spark)}/{name}").saveAsTable(name))
    moved = None
    for r in range(repeats):
        mine = hash_ranks(numbered.select(*keys, "_row"), keys, 100 + r).select("rank", "_row")
        partner = hash_ranks(numbered.select(*dict.fromkeys([*keys, *features])), keys, 200 + r)
        part = mine.join(partner.select("rank", F.struct(*features).alias("other")), "rank").select(
            "_row", F.struct(F.lit(r).alias("repeat"), "other").alias("pair"))
        moved = part if moved is None else moved.unionByName(part)
    # One pair a repeat for each row.
    pairs = moved.groupBy("_row").agg(F.sort_array(F.collect_list("pair")).alias("_others"))
    return spark.table(name).join(pairs, "_row").select(
        *df.columns, F.transform("_others", lambda p: p["other"]).alias("_others"))


def permutation_importance(trained: Trained, df: DataFrame, label: str,
                           features: Sequence[str], repeats: int = 5,
                           keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """ROC-AUC lost when one column is shuffled: mean and deviation over repeats. All columns and
    repeats are scored in one pass; the value of a tested column comes from another row.

    Rows are prepared once: a place of the vector is made of one column, so a column is swapped by
    swapping its places.
    """
    places = trained.preprocessor.places_of()
    asked = sorted({i for f in features for i in places.get(f, [])})
    vector = F.col("_vector")
    width = len(trained.preprocessor.names)
    prepared = trained.preprocessor.transform(df).select(
        *dict.fromkeys([*keys, label]), vector_to_array("features").alias("_vector"),
        *[vector_to_array("features")[i].alias(f"_{i}") for i in asked])
    # Only the tested places of the other row are exchanged.
    paired = permuted_rows(prepared, [f"_{i}" for i in asked], repeats, keys) if asked else \
        prepared.withColumn("_others", F.array_repeat(F.struct(F.lit(0)), repeats))
    paired = paired.select(F.col(label).alias("label"), "_vector",
                           F.posexplode("_others").alias("_repeat", "_other"))
    variants = []
    for n, f in enumerate(features):
        mine = set(places.get(f, []))
        values = F.array(*[F.col(f"_other._{i}") if i in mine else vector[i]
                           for i in range(width)])
        variants.append(F.struct(F.lit(n).alias("_feature"), values.alias("_values")))
    shuffled = paired.select("label", "_repeat", F.inline(F.array(*variants))).select(
        "label", (F.col("_feature") * repeats + F.col("_repeat")).alias("_variant"),
        array_to_vector("_values").alias("features", metadata=trained.preprocessor.described))
    scored = trained.score_prepared(shuffled).select("_variant", "label", "score")
    plain = cut(trained.score(df).select(F.col(label).alias("label"), "score"))
    whole = evaluate.roc_auc(plain).first().roc_auc
    drops = evaluate.roc_auc(scored, ["_variant"]).withColumn(
        "drop", F.lit(whole) - F.col("roc_auc"))
    named = F.element_at(F.array(*map(F.lit, features)),
                         F.floor(F.col("_variant") / repeats).cast("int") + 1)
    return drops.groupBy(named.alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))


def partial_dependence(trained: Trained, df: DataFrame, col: str, grid: Sequence[float],
                       cls: int = 1) -> DataFrame:
    """Mean probability of class `cls` with the column set to each grid value in turn, all values
    in one pass."""
    return _dependence(trained, df, col, grid, [cls]).select(
        "value", F.col("means")[0].alias("mean_score"), "rows")


def partial_dependence_by_class(trained: Trained, df: DataFrame, col: str, grid: Sequence[float],
                                names: Sequence[str], name: str) -> DataFrame:
    """The curves of `partial_dependence` for all classes from one pass; `name` tells the class."""
    means = _dependence(trained, df, col, grid, range(len(names)))
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("c"), F.col("means"))
    return means.select("value", "rows", F.inline(pairs).alias(name, "mean_score")).select(
        "value", "mean_score", "rows", name)


def _dependence(trained: Trained, df: DataFrame, col: str, grid: Sequence[float],
                classes: Sequence[int]) -> DataFrame:
    """(value, means, rows): mean probabilities of the classes for each grid value."""
    values = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
    filled = df.withColumn("_grid", values).withColumn(col, F.col("_grid"))
    p = vector_to_array("probability")
    scored = trained.predict(filled).select("_grid", *[p[c].alias(f"_p{c}") for c in classes])
    return scored.groupBy(F.col("_grid").alias("value")).agg(
        F.array(*[F.avg(f"_p{c}") for c in classes]).alias("means"), F.count("*").alias("rows"))
