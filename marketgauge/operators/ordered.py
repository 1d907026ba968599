"""Totals over a global order without sorting a whole table, or a hot group, in one task.

`running_totals` range-partitions its already aggregated input by (group, order), writes it
once, and adds per-partition offsets. Exact quantiles and the score curves build on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counted

# Up to this many distinct values the built-in `percentile` keeps its value map in memory.
PERCENTILE_DISTINCT_LIMIT = 100_000
# Up to this many, every value is ranked; beyond, only those near the wanted ranks.
RANK_ALL_LIMIT = 5_000_000
MAX_BRACKETED_GROUPS = 10_000


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[Column],
            sums: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Range-partitioned copy of `df`, and per (group, partition) the totals before it."""
    ranged = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    # The partition number is only stable in a written copy.
    placed = cut(ranged)
    # At most partitions + groups rows from here on.
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by, "_part", *[F.col(f"_all_{c}") for c in sums],
        *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}")
          for c in sums])
    return placed, offsets


def _within(by: Sequence[str], order: Sequence[Column]):
    return (Window.partitionBy(*by, "_part").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str],
                   sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds `cum_<c>`: the total of `c` up to and including the row, in `order` within `by`.

    `by` and `order` together must be unique and `by` must not hold NULL.
    """
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    placed, offsets = _placed(df, by, keys, sums)
    inner = _within(by, keys)
    summed = placed.withColumns({f"_in_{c}": F.sum(c).over(inner) for c in sums})
    joined = summed.join(offsets, [*by, "_part"])
    return (joined
            .withColumns({f"cum_{c}": F.col(f"_in_{c}") + F.col(f"_before_{c}") for c in sums})
            .select(*df.columns, *[f"cum_{c}" for c in sums]))


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by.., column, value) for the non-NULL values."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
             for c in cols]
    return df.select(*by, F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())


def _thinned(long: DataFrame, groups: Sequence[str], probs: Sequence[float],
             accuracy: int) -> DataFrame | None:
    """Values near the wanted ranks as they are; all others replaced by the end of the bracket
    below them (`gap` 1), so they merge into a few counts before any shuffle.

    The brackets come from a sketch with rank error 1 / accuracy. None if there are too many
    groups for a broadcast of their brackets.
    """
    slack = 2 / accuracy
    levels = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = long.groupBy(*groups).agg(F.percentile_approx(
        "value", F.array(*map(F.lit, levels)), accuracy).alias("_q"))
    brackets, rows = cut_counted(sketch.select(
        *groups, F.slice("_q", 1, len(probs)).alias("_lo"),
        F.slice("_q", len(probs) + 1, len(probs)).alias("_hi")))
    if rows > MAX_BRACKETED_GROUPS:
        return None
    v = F.col("value")
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda s: (s["_lo"] <= v) & (v <= s["_hi"]))
    below = F.array_max(F.filter("_hi", lambda h: h < v))
    near = long.join(F.broadcast(brackets), list(groups)).withColumn("_in", inside)
    return near.select(
        *groups, F.when(F.col("_in"), v).otherwise(
            F.coalesce(below, F.lit(float("-inf")))).alias("value"),
        F.when(F.col("_in"), 0).otherwise(1).alias("gap"))


def _ranked_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      by: Sequence[str], accuracy: int | None) -> DataFrame:
    groups = [*by, "column"]
    long = _long(df, cols, by)
    thin = None if accuracy is None else _thinned(long, groups, probs, accuracy)
    if thin is None:
        return _rank_values(long.withColumn("gap", F.lit(0)), groups, probs)
    found, rows = cut_counted(_rank_values(thin, groups, probs))
    missing = found.filter(F.exists("quantiles", lambda x: x.isNull())
                           | (F.size("quantiles") < len(probs)))
    # A rank outside its bracket would show as a gap; then every value is ranked.
    if rows and not missing.isEmpty():
        return _ranked_quantiles(df, cols, probs, by, None)
    return found


def _rank_values(values: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(groups.., quantiles[]): NULL where a wanted rank falls in a gap."""
    counts = values.groupBy(*groups, "value", "gap").agg(F.count("*").alias("n"))
    order = [F.col("value"), F.col("gap")]
    placed, offsets = _placed(counts, groups, order, ["n"])
    totals = offsets.groupBy(*groups).agg(F.sum("_all_n").alias("_total"))
    # Zero-based target position (n - 1) * p, linear between its two neighbours.
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                       for i, p in enumerate(probs)])
    targets = (totals.select(*groups, "_total", F.explode(points).alias("pt"))
               .select(*groups, F.col("pt.i").alias("i"),
                       ((F.col("_total") - 1) * F.col("pt.p")).alias("pos"))
               .withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")}))
    # Partitions whose rank range holds no target are dropped before the sort.
    first, last = F.col("_before_n"), F.col("_before_n") + F.col("_all_n") - 1
    needed = (offsets.join(targets, groups)
              .filter(((F.col("lo") >= first) & (F.col("lo") <= last))
                      | ((F.col("hi") >= first) & (F.col("hi") <= last)))
              .select(*groups, "_part", "_before_n").distinct())
    ranked = (placed.join(needed, [*groups, "_part"])
              .withColumn("_end", F.col("_before_n")
                          + F.sum("n").over(_within(groups, order)))
              .withColumn("_start", F.col("_end") - F.col("n")))
    at_lo = (F.col("lo") >= F.col("_start")) & (F.col("lo") < F.col("_end"))
    at_hi = (F.col("hi") >= F.col("_start")) & (F.col("hi") < F.col("_end"))
    found = (ranked.join(targets, groups).filter(at_lo | at_hi)
             .groupBy(*groups, "i", "pos", "lo")
             .agg(F.max(F.when(at_lo & (F.col("gap") == 0), F.col("value"))).alias("a"),
                  F.max(F.when(at_hi & (F.col("gap") == 0), F.col("value"))).alias("b"))
             .withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("lo"))))
    # One entry per probability: the list is as long as `probs`.
    return (found.groupBy(*groups)
            .agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("_list"))
            .select(*groups, F.transform("_list", lambda s: s.q).alias("quantiles")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), distinct_limit: int = PERCENTILE_DISTINCT_LIMIT,
                    rank_all_limit: int = RANK_ALL_LIMIT,
                    accuracy: int | None = 10_000) -> DataFrame:
    """Exact quantiles, linear between neighbours: rows (by.., column, quantiles[]).

    `percentile` keeps every distinct value of a group in one task, so it is used only when a
    sketch counts few of them. A middle number is ranked across range partitions. Beyond that a
    second sketch brackets the wanted ranks and values outside the brackets collapse into
    counts, so hardly any value is shuffled. NULL groups are left out.
    """
    by = list(by)
    for key in by:
        df = df.filter(F.col(key).isNotNull())
    sketch = df.agg(*[F.approx_count_distinct(F.struct(*by, c)).alias(c) for c in cols]).first()
    if distinct_limit < sum(sketch) <= rank_all_limit:
        accuracy = None
    if sum(sketch) > distinct_limit:
        return _ranked_quantiles(df, cols, probs, by, accuracy)
    levels = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), levels).alias(c)
                                 for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("quantiles")) for c in cols]
    return (wide.select(*by, F.inline(F.array(*pairs)))
            .filter(F.col("quantiles").isNotNull()))


def quantile_values(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """The quantiles of one column as numbers (fitting step: `len(probs)` values)."""
    row = exact_quantiles(df, [col], probs).first()
    if row is None:
        raise ValueError(f"no numeric values in {col}")
    return list(row.quantiles)


def dense_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): 0-based position of each distinct value in sorted order."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in cols]
    values = (df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
              .distinct().withColumn("one", F.lit(1)))
    ranked = running_totals(values, ["column"], ["value"], ["one"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("long").alias("code"))
