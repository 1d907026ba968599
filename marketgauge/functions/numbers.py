"""Arithmetic with one kind of missing value: NULL instead of NaN, inf or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0 or either side is NULL."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a,
                        F.col(b) if isinstance(b, str) else b)


def round_half_even(c, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back (as array libraries round)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10 ** digits))
    return F.rint(c * scale) / scale


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with NULL counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_present(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNotNull().cast("int")


def safe_ln(c, floor: float = 0.01) -> Column:
    """Natural log after clipping at `floor`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(floor))))


def finite_or_null(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become NULL."""
    doubles = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    limit = F.lit(float("inf"))
    return df.withColumns({c: F.when(F.abs(F.col(c)) < limit, F.col(c)) for c in doubles})
