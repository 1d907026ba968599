"""Mutual information of a number with a class by nearest neighbours.

The estimator compares how close the k-th neighbour of a row's own class is with how many rows of
all classes are as close. Numbers lie on a line, so neighbours stand next to each other in sorted
order: positions within a class and running totals over all rows replace any pairing of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut
from .ordered import running_totals

K = 3
RESOLUTION = 1e-6
BLOCK = 50_000
# Order of a probe and the numbers at its place: before them, the numbers, after them.
BEFORE, AT, AFTER = 0, 1, 2


def digamma(x: Column) -> Column:
    """Digamma of whole numbers from 1 on, to about 1e-9: six steps up, then its series."""
    z = x + 6.0
    steps = sum((1 / (x + float(j)) for j in range(1, 6)), 1 / x.cast("double"))
    return (F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, F.lit(4)))
            - 1 / (252 * F.pow(z, F.lit(6))) - steps)


def _cells(df: DataFrame, label: str, columns: Sequence[str], resolution: float) -> DataFrame:
    """(column, y, x, n): numbers in units of `resolution`, with their rows for each class."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
             for c in columns]
    units = F.floor(F.col("v") / resolution + 0.5)
    return (df.filter(F.col(label).isNotNull())
            .select(F.col(label).alias("y"), F.inline(F.array(*pairs)))
            .filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") / resolution < 2 ** 60))
            .groupBy("column", "y", units.alias("x")).agg(F.count("*").alias("n")))


def _with_radius(cells: DataFrame, k: int, block: int) -> DataFrame:
    """Adds `radius`: the distance of the k-th other row of the class (of the last one, in a class
    of fewer). The k rows before and after stand in one block of the class's order, or at the edge
    of the next, which is copied."""
    placed = running_totals(cells.withColumn("one", F.lit(1)), ["column", "y"], ["x"], ["one"])
    place = F.col("cum_one") - 1
    own = F.floor(place / block)
    near = F.array_compact(F.array(
        own, F.when(place % block < k, own - 1), F.when(place % block >= block - k, own + 1)))
    spread = placed.withColumn("own", own).withColumn("block", F.explode(near))
    order = Window.partitionBy("column", "y", "block").orderBy("x")
    others = [F.struct(F.abs(F.col("x") - f("x", j).over(order)).alias("far"),
                       f("n", j).over(order).alias("n"))
              for f in (F.lag, F.lead) for j in range(1, k + 1)]
    beside = spread.withColumn("others", F.array(*others)).filter(F.col("own") == F.col("block"))
    beside = beside.withColumn("others", F.array_sort(F.filter(
        "others", lambda o: o["far"].isNotNull())))
    start = F.struct((F.col("n") - 1).alias("seen"), F.lit(0).cast("long").alias("far"))
    radius = F.aggregate("others", start, lambda s, o: F.when(s["seen"] >= F.col("k"), s).otherwise(
        F.struct((s["seen"] + o["n"]).alias("seen"), o["far"].alias("far"))), lambda s: s["far"])
    return beside.withColumn("radius", radius).drop("others", "own", "block", "one", "cum_one")


def _with_rows_within(cells: DataFrame, all_cells: DataFrame) -> DataFrame:
    """Adds `m`: the rows of all classes nearer than the radius, the row itself included; with
    radius 0 the rows at its place."""
    x, r = F.col("x"), F.col("radius")
    zero = F.lit(0).cast("long")
    ends = F.array(
        F.struct((x - r).alias("at"), F.when(r > 0, AFTER).otherwise(BEFORE).alias("kind"),
                 F.lit(-1).alias("sign")),
        F.struct((x + r).alias("at"), F.when(r > 0, BEFORE).otherwise(AFTER).alias("kind"),
                 F.lit(1).alias("sign")))
    own = ["y", "x", "n", "k", "rows"]
    probes = cells.select("column", F.struct(*own).alias("cell"), F.inline(ends),
                          zero.alias("held"))
    numbers = all_cells.groupBy("column", F.col("x").alias("at")).agg(F.sum("n").alias("held"))
    both = probes.unionByName(numbers.withColumn("kind", F.lit(AT)), allowMissingColumns=True)
    # Probes add nothing, so those of one place need no order among them.
    # Written: range partitions are sampled first, which else works all of it out twice.
    counted = running_totals(cut(both), ["column"], ["at", "kind"], ["held"])
    return (counted.filter(F.col("sign").isNotNull()).groupBy("column", "cell")
            .agg(F.sum(F.col("sign") * F.col("cum_held")).alias("m"))
            .select("column", "cell.*", "m"))


def neighbour_information(df: DataFrame, label: str, columns: Sequence[str], k: int = K,
                          resolution: float = RESOLUTION, top: int | None = None,
                          block: int = BLOCK) -> DataFrame:
    """(column, mi): nearest-neighbour estimate in nats, not below 0, best first.

    mi = psi(N) + mean of psi(k) - psi(rows of the class) - psi(m) over the rows of a column with
    a value and a label. Rows of a class of one are left out. Numbers are compared in units of
    `resolution`, so that ties and distances are exact; equal numbers are at distance 0 (no noise
    is added to tell them apart). A column without such rows has no row in the result.

    Rows collapse to one for each different number and class. No class or column meets in one
    task: blocks of a class's order hold `block` numbers, running totals go over range partitions.
    """
    # Rows are reduced once; all later steps read the written numbers.
    cells = cut(_cells(df, label, columns, resolution))
    classes = (cells.groupBy("column", "y").agg(F.sum("n").alias("rows"))
               .filter(F.col("rows") > 1)
               .withColumn("k", F.least(F.lit(k).cast("long"), F.col("rows") - 1)))
    kept = cells.join(checked_broadcast(classes), ["column", "y"])
    found = _with_rows_within(_with_radius(kept, k, block), kept)
    n = F.col("n")
    gain = n * (digamma(F.col("k")) - digamma(F.col("rows")) - digamma(F.col("m")))
    scores = found.groupBy("column").agg(
        F.greatest(F.lit(0.0), digamma(F.sum("n")) + F.sum(gain) / F.sum("n")).alias("mi"))
    ranked = scores.orderBy(F.desc("mi"), "column")
    return ranked if top is None else ranked.limit(top)
