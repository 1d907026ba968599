"""Readers, writers and cheap looks at a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import parse_number


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail at analysis time when an expected column is absent (wrong delimiter, wrong file)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; the table has {df.columns}")
    return df


def _read_csv(spark: SparkSession, path: str, wanted: T.StructType, sep: str) -> DataFrame:
    """Every column is read as text and parsed: what is not a number of the wanted kind raises."""
    raw = spark.read.option("sep", sep).option("header", True).csv(path)
    require_columns(raw, wanted.names)
    return raw.select(*[strict(f).alias(f.name) for f in wanted.fields])


def strict(wanted: T.StructField) -> Column:
    """Text as the wanted type. Empty text and nan are NULL, 7.0 is a whole number, other text
    that does not parse fails the job and names the column and the value."""
    text = F.trim(F.col(f"`{wanted.name}`"))
    if isinstance(wanted.dataType, T.StringType):
        return F.col(f"`{wanted.name}`")
    number = parse_number(text)
    kind = wanted.dataType.simpleString()
    if isinstance(wanted.dataType, T.IntegralType):
        # Whole numbers are cast from the text, which keeps all digits of a long.
        whole = text.try_cast(kind)
        value = F.when(text.rlike(r"^[+-]?\d+$"), whole).when(
            number == F.floor(number), number.try_cast(kind))
    else:
        value = number.cast(kind)
    missing = text.isNull() | (text == "") | (F.lower(text) == "nan")
    wrong = F.raise_error(F.concat(F.lit(f"column {wanted.name}: not a {kind}: "), text))
    return F.when(missing, F.lit(None)).otherwise(F.coalesce(value, wrong)).cast(kind)


def read_items(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    return _read_csv(spark, path, schema.ITEMS, sep)


def read_interactions(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    return _read_csv(spark, path, schema.INTERACTIONS, sep)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The unified feature table or a sample of it, Parquet or '|' CSV."""
    if fmt == "csv":
        return _read_csv(spark, path, schema.FEATURES, "|")
    return require_columns(spark.read.format(fmt).load(path), schema.FEATURES.names)


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Parquet partitioned by day, so period filters and time splits skip whole folders."""
    if fmt == "csv":
        df.write.mode(mode).option("sep", "|").option("header", True).csv(path)
        return
    # One shuffle by day; Spark splits the days that are larger than its target size, so a day's
    # files and tasks follow from its bytes.
    df.hint("rebalance", F.col("day")).write.mode(mode).partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, sep: str = "|",
              mode: str = "error") -> None:
    """CSV sink; `single_file` is for report tables of a few rows only."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode).option("sep", sep).option("header", True)
     # Blanks at the ends of a value are part of it.
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def preview(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded random `n` rows: the smallest key hashes, kept by a per-task top-n."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def long_form(row: DataFrame, columns: Sequence[str], name: str = "column",
              value: str = "value") -> DataFrame:
    """One wide row of per-column results, named after the columns, as (name, value) rows."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns]
    return row.select(F.inline(F.array(*pairs)))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, type and missing count, most missing first; one pass over the data."""
    types = dict(df.dtypes)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"`{c}`").alias("missing")) for c in df.columns]
    return counts.select(F.inline(F.array(*rows))).orderBy(F.desc("missing"), "column")
