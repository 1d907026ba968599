"""Words, sizes and seeded orders that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def shuffle_key(seed: int, *columns: str) -> Column:
    """A seeded random order as 32 hex digits, equal in every engine that has md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bucket_digits(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hex digits of a shuffle key that leave about `per_bucket` rows together."""
    digits = 1
    while rows > per_bucket * 16 ** digits:
        digits += 1
    return digits


def totals_before(df: DataFrame, group: list[str], bucket: str, order: list[str],
                  value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the group that come earlier.

    `bucket` must rise with `order`. Only (group, bucket) meets in one task, never a whole group;
    what the earlier buckets hold is summed from one row for each bucket. Groups may be NULL.
    """
    keys = [*group, bucket]
    held, offset, local = spare(df, "_held", "_offset", "_local")
    of = dict(zip(keys, spare(df, *[f"_{k}" for k in keys])))
    per_bucket = df.groupBy(*keys).agg(F.sum(value).alias(held))
    w = Window.partitionBy(*group).orderBy(bucket) if group else Window.orderBy(bucket)
    offsets = per_bucket.select(
        *[F.col(k).alias(of[k]) for k in keys],
        F.coalesce(F.sum(held).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(offset))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(local, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [*[F.col(g).eqNullSafe(F.col(of[g])) for g in group], F.col(bucket) == F.col(of[bucket])]
    return (inside.join(offsets, on).withColumn(name, F.col(local) + F.col(offset))
            .drop(local, offset, *of.values()))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of `df` has, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once. A column that a lambda names is put into it as an
    expression, which runs again for every element; a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
