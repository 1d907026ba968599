"""Bins over known edges. Edges are a handful of numbers fitted once and put in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_closed_bin(c: Column, edges: Sequence[float]) -> Column:
    """1 + number of inner edges <= c, so [-inf, e1) is 1 and [e1, e2) is 2."""
    if not edges:
        return F.when(c.isNotNull(), 1)
    cell = F.when(c < float(edges[0]), 1)
    for i, edge in enumerate(edges[1:], start=2):
        cell = cell.when(c < float(edge), i)
    return cell.when(c.isNotNull(), len(edges) + 1)


def right_closed_bin(c: Column, edges: Sequence[float]) -> Column:
    """1 + number of inner edges < c, so (-inf, e1] is 1 and (e1, e2] is 2."""
    if not edges:
        return F.when(c.isNotNull(), 1)
    cell = F.when(c <= float(edges[0]), 1)
    for i, edge in enumerate(edges[1:], start=2):
        cell = cell.when(c <= float(edge), i)
    return cell.when(c.isNotNull(), len(edges) + 1)


def fixed_bin(c: Column, edges: Sequence[float], right: bool = False) -> Column:
    return right_closed_bin(c, edges) if right else left_closed_bin(c, edges)


def labelled_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with names; NULL stays NULL."""
    if not edges:
        return F.when(c.isNotNull(), labels[0])
    name = F.when(c <= float(edges[0]), labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        name = name.when(c <= float(edge), label)
    return name.when(c.isNotNull(), labels[len(edges)])


def equal_width_edges(df: DataFrame, col: str) -> tuple[float, float]:
    """Smallest and largest value: all an equal-width grid needs."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if row.lo is None:
        raise ValueError(f"no numeric values in {col}")
    return float(row.lo), float(row.hi)


def equal_width_bin(c: Column, lo: float, hi: float, n: int, right: bool = True) -> Column:
    """Bin 1..n over [lo, hi]; right-closed with the lowest value in bin 1, or left-closed
    with the highest in bin n."""
    if hi == lo:
        return F.when(c.isNotNull(), F.lit(1).cast("int"))
    place = (c - F.lit(lo)) / F.lit((hi - lo) / n)
    index = F.ceil(place) if right else F.floor(place) + 1
    return F.greatest(F.lit(1), F.least(F.lit(n), index)).cast("int")


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins over quantile edges with repeated edges dropped; 1-based."""
    return right_closed_bin(c, sorted(set(edges))[1:-1])
