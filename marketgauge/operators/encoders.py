"""Encoders that learn from the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import flag, ratio
from ..session import cut, cut_counted
from .joins import join_counted, lookup
from .ordered import dense_codes

INFREQUENT = "__infrequent__"


def _sizes(df: DataFrame, cols: Sequence[str], weight: str | None) -> DataFrame:
    """(column, value, c): rows per value of each column, NULL included; one aggregation."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in cols]
    n = F.lit(1) if weight is None else F.col(weight)
    return (df.select(n.alias("_w"), F.inline(F.array(*pairs)))
            .groupBy("column", "value").agg(F.sum("_w").alias("c")))


def _thresholds(sizes: DataFrame, target: float) -> DataFrame:
    """(column, threshold) from the value counts.

    Values with equal counts are interchangeable, so the running sum goes over distinct counts:
    fewer than sqrt(2 x rows) of them per column, small for any table.
    """
    runs = sizes.groupBy("column", "c").agg(F.count("*").alias("m"))
    per = Window.partitionBy("column")
    down = per.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = F.col("c") * F.col("m")
    walked = runs.select("column", "c", "m", (F.sum(rows).over(down) - rows).alias("before"),
                         F.sum(rows).over(per).alias("total"))
    # In a run of m equal counts, this many keep the cumulative share within the target.
    room = F.floor((F.lit(target) * F.col("total") - F.col("before")) / F.col("c"))
    one_more = (F.col("before") + (room + 1) * F.col("c")) / F.col("total") <= target
    inside = F.greatest(F.lit(0), F.least(F.col("m"), room + F.when(one_more, 1).otherwise(0)))
    # The threshold is the first count with a value outside; coverage 1.0 keeps every value.
    outside = F.max(F.when(inside < F.col("m"), F.col("c")))
    return walked.groupBy("column").agg(F.coalesce(outside, F.min("c")).alias("threshold"))


def coverage_threshold(df: DataFrame, cols: Sequence[str], target: float = 0.95,
                       weight: str | None = None) -> DataFrame:
    """(column, threshold): the count a value needs so that the values at or above it cover
    about `target` of the rows. NULL counts as a value. `weight` holds the number of rows a
    pre-aggregated row stands for.
    """
    return _thresholds(_sizes(df, cols, weight), target)


def group_rare(df: DataFrame, cols: Sequence[str], target: float = 0.95,
               label: str = "other", counted: DataFrame | None = None,
               weight: str | None = None) -> DataFrame:
    """Values rarer than the coverage threshold become `label`; NULL stays NULL.

    `counted` with a `weight` column replaces the counting pass over `df` by a smaller table.
    """
    sizes = cut(_sizes(df if counted is None else counted, cols, weight))
    # One threshold row per column.
    rare, rows = cut_counted(
        sizes.join(F.broadcast(_thresholds(sizes, target)), "column")
        .filter(F.col("value").isNotNull() & (F.col("c") < F.col("threshold")))
        .select("column", "value"))
    out = df
    for c in cols:
        mine = rare.filter(F.col("column") == c).select(F.col("value").alias(c),
                                                        F.lit(True).alias("_rare"))
        out = join_counted(out.withColumn(c, F.col(c).cast("string")), mine, [c], rows)
        out = out.withColumn(c, F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(c)))
        out = out.drop("_rare")
    return out.select(*df.columns)


def frequent_levels(train: DataFrame, col: str, min_frequency: float) -> DataFrame:
    """(value) seen often enough in train: an absolute count, or a share below 1."""
    counts = (train.filter(F.col(col).isNotNull())
              .groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n")))
    if min_frequency < 1:
        total = train.agg(F.count("*").alias("n")).scalar()
        return counts.filter(F.col("n") >= total * min_frequency).select("value")
    return counts.filter(F.col("n") >= min_frequency).select("value")


def merge_infrequent(train: DataFrame, df: DataFrame, cols: Sequence[str],
                     min_frequency: float) -> DataFrame:
    """Rare and unseen values share one level; NULL counts as unseen."""
    out = df
    for c in cols:
        kept = frequent_levels(train, c, min_frequency).select(
            F.col("value").alias(c), F.lit(True).alias("_kept"))
        out = lookup(out.withColumn(c, F.col(c).cast("string")), kept, [c])
        out = out.withColumn(c, F.when(F.col("_kept"), F.col(c)).otherwise(INFREQUENT))
        out = out.drop("_kept")
    return out.select(*df.columns)


def levels(df: DataFrame, col: str, limit: int = 1000) -> list[str]:
    """Sorted distinct values of a column that becomes one column per value.

    A table cannot have more than `limit` such columns, so more levels raise; `sparse_one_hot`
    takes any number.
    """
    rows = (df.select(F.col(col).cast("string").alias("v")).filter(F.col("v").isNotNull())
            .distinct().limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} levels; merge rare ones first")
    return sorted(r.v for r in rows)


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
            fit_on: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per sorted level, the first left out with `drop_first`."""
    hot: dict[str, Column] = {}
    for c in cols:
        for v in levels(df if fit_on is None else fit_on, c)[1 if drop_first else 0:]:
            hot[f"{c}_{v}"] = flag(F.col(c).cast("string") == v)
    return df.withColumns(hot).drop(*cols)


def level_table(df: DataFrame, cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """(column, value, index), written: the sorted levels of each column, numbered through the
    columns in their order; the first of each is left out with `drop_first`. For any number of
    levels: they are ranked over range partitions."""
    codes = cut(dense_codes(df, cols))
    skipped = int(drop_first)
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("column"))
    # One row for each column.
    sizes = codes.groupBy("column").agg((F.max("code") + 1 - skipped).alias("_n"))
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    kept = codes.filter(F.col("code") >= skipped).join(F.broadcast(offsets), "column")
    return cut(kept.select("column", "value",
                           (F.col("code") - skipped + F.col("_from")).alias("index")))


def sparse_one_hot(df: DataFrame, cols: Sequence[str], table: DataFrame,
                   name: str = "levels") -> DataFrame:
    """Adds `name`: the rising indices of the row's levels in a `level_table`, the ones of a sparse
    0/1 row; a level that is not in the table (unseen, NULL, the first dropped) has none."""
    out = df
    for i, c in enumerate(cols):
        mine = table.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v{i}"), F.col("index").alias(f"_i{i}"))
        out = lookup(out.withColumn(f"_v{i}", F.col(c).cast("string")), mine, [f"_v{i}"],
                     stored=True)
    found = F.sort_array(F.array_compact(F.array(*[F.col(f"_i{i}") for i in range(len(cols))])))
    return out.withColumn(name, found).select(*df.columns, name)


def label_encode(df: DataFrame, cols: Sequence[str], order: str = "sorted") -> DataFrame:
    """`<col>_code`: position of the value in sorted order, or in order of first appearance
    (by the smallest lineID that carries it)."""
    codes, rows = cut_counted(dense_codes(df, cols) if order == "sorted"
                              else _appearance_codes(df, cols))
    out = df
    for c in cols:
        one = codes.filter(F.col("column") == c).select(
            F.col("value").alias(f"_{c}"), F.col("code").alias(f"{c}_code"))
        out = join_counted(out.withColumn(f"_{c}", F.col(c).cast("string")), one, [f"_{c}"],
                           rows).drop(f"_{c}")
    return out


def _appearance_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from .ordered import running_totals
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in cols]
    firsts = (df.select("lineID", F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.min("lineID").alias("first"))
              .withColumn("one", F.lit(1)))
    ranked = running_totals(firsts, ["column"], ["first", "value"], ["one"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("long").alias("code"))


def _key(value: Column) -> Column:
    """NULL is a level of its own, so the key is made joinable."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _target_stats(df: DataFrame, cols: Sequence[str], label: str, fold: Column) -> DataFrame:
    """(column, _key, _fold, n, s): rows and label sum per value and fold, all columns in one
    aggregation; a hot value combines before the shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), _key(F.col(c)).alias("_key")) for c in cols]
    return (df.select(fold.alias("_fold"), F.col(label).alias("_y"), F.inline(F.array(*pairs)))
            .groupBy("column", "_key", "_fold")
            .agg(F.count("*").alias("n"), F.sum("_y").cast("double").alias("s")))


def _shrunk(n: Column, s: Column, big_n: Column, big_s: Column) -> Column:
    """Empirical-Bayes mean of a 0/1 label: the level mean pulled to the global mean by
    n / (n + level variance / global variance)."""
    mean, overall = ratio(s, n), ratio(big_s, big_n)
    pull = ratio(mean * (1 - mean), overall * (1 - overall))
    weight = ratio(n, n + pull)
    return F.when(n > 0, weight * mean + (1 - weight) * overall).otherwise(overall)


def target_encode_cv(df: DataFrame, cols: Sequence[str], label: str, fold: Column,
                     rows_of: DataFrame | None = None) -> DataFrame:
    """Adds `<col>_te`: the encoding of a row learned from the other folds only. `rows_of` names
    some rows of `df` that alone are encoded, from all of `df`."""
    stats = _target_stats(df, cols, label, fold)
    value = Window.partitionBy("column", "_key")
    # One row per fold and column after this aggregation.
    folds = stats.groupBy("column", "_fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    every = Window.partitionBy("column")
    folds = folds.select("column", "_fold", (F.sum("fn").over(every) - F.col("fn")).alias("bn"),
                         (F.sum("fs").over(every) - F.col("fs")).alias("bs"))
    rest = stats.withColumns({"n": F.sum("n").over(value) - F.col("n"),
                              "s": F.sum("s").over(value) - F.col("s")})
    encoded, rows = cut_counted(rest.join(F.broadcast(folds), ["column", "_fold"]).select(
        "column", "_key", "_fold",
        _shrunk(F.col("n"), F.col("s"), F.col("bn"), F.col("bs")).alias("te")))
    out = (df if rows_of is None else rows_of).withColumn("_fold", fold)
    for c in cols:
        mine = encoded.filter(F.col("column") == c).select("_key", "_fold",
                                                           F.col("te").alias(f"{c}_te"))
        out = join_counted(out.withColumn("_key", _key(F.col(c))), mine, ["_key", "_fold"], rows)
        out = out.drop("_key")
    return out.drop("_fold")


@dataclass
class TargetTable:
    """Encodings learned on all train rows, written once, and the global mean."""

    table: DataFrame
    rows: int
    default: float
    cols: Sequence[str]

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds `<col>_te`; values the table does not know get the global mean."""
        out = df
        for c in self.cols:
            mine = self.table.filter(F.col("column") == c).select(
                "_key", F.col("te").alias(f"{c}_te"))
            out = join_counted(out.withColumn("_key", _key(F.col(c))), mine, ["_key"], self.rows)
            out = out.drop("_key").withColumn(
                f"{c}_te", F.coalesce(F.col(f"{c}_te"), F.lit(self.default)))
        return out


def target_table(train: DataFrame, cols: Sequence[str], label: str) -> TargetTable:
    row = train.agg(F.count("*").alias("n"), F.sum(label).cast("double").alias("s")).first()
    encoded = _target_stats(train, cols, label, F.lit(0)).select(
        "column", "_key", _shrunk(F.col("n"), F.col("s"), F.lit(float(row.n)),
                                  F.lit(row.s)).alias("te"))
    table, rows = cut_counted(encoded)
    return TargetTable(table, rows, row.s / row.n, list(cols))


def target_encode(train: DataFrame, df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Adds `<col>_te` learned on all of `train`; unseen values get the global mean."""
    return target_table(train, cols, label).apply(df)


def standardize(train: DataFrame, df: DataFrame, cols: Sequence[str],
                with_mean: bool = True) -> DataFrame:
    """(x - mean) / population std of `train`; a constant column is only centred."""
    moments = F.struct(*[F.avg(c).alias(f"{c}_m") for c in cols],
                       *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    fitted = train.agg(moments.alias("m")).scalar()
    scaled = {}
    for c in cols:
        centre = fitted.getField(f"{c}_m") if with_mean else F.lit(0.0)
        spread = fitted.getField(f"{c}_s")
        scaled[c] = (F.col(c) - centre) / F.when(spread > 0, spread).otherwise(F.lit(1.0))
    return df.withColumns(scaled)


def spline_ends(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column (the fitting step)."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"),
                            F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).first()
    return {c: (row[c].lo, row[c].hi) for c in cols}


def spline_basis(df: DataFrame, cols: Sequence[str], knots: int = 5, degree: int = 3,
                 ends: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds `<col>_sp0..`: uniform B-splines over the fitted range, the last one left out.

    Values outside the fitted range take the value at the border.
    """
    ends = spline_ends(df, cols) if ends is None else ends
    out = df
    for c in cols:
        lo, hi = ends[c]
        step = (hi - lo) / (knots - 1)
        if step == 0:
            raise ValueError(f"{c} is constant; a spline needs a range")
        # Position in knot units; cell is the knot interval, the top end closed.
        at = (F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))) - lo) / step
        out = out.withColumn("_x", at)
        cell = F.least(F.floor("_x"), F.lit(knots - 2))
        out = out.withColumns({"_cell": cell, "_u": F.col("_x") - cell})
        pieces = _uniform_pieces(F.col("_u"), degree)
        # Inside cell j exactly the splines j .. j + degree are non-zero.
        basis = {}
        for b in range(knots + degree - 2):
            value = F.lit(0.0)
            for k, piece in enumerate(pieces):
                value = F.when(F.col("_cell") == b - k, piece).otherwise(value)
            basis[f"{c}_sp{b}"] = F.when(F.col("_x").isNotNull(), value)
        out = out.withColumns(basis).drop("_x", "_cell", "_u")
    return out


def _uniform_pieces(u: Column, degree: int) -> list[Column]:
    """The degree + 1 uniform B-splines that are non-zero on one knot interval, at u in [0, 1].

    Cox-de Boor with unit knot distance: B(k, d) = ((u + d - k) B(k-1, d-1) + (k + 1 - u)
    B(k, d-1)) / d, where k counts the splines from left to right.
    """
    pieces = [F.lit(1.0)]
    for d in range(1, degree + 1):
        zero = F.lit(0.0)
        padded = [zero, *pieces, zero]
        pieces = [((u + (d - k)) * padded[k] + ((k + 1) - u) * padded[k + 1]) / d
                  for k in range(d + 1)]
    return pieces
