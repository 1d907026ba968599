"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import ROWS_PER_BUCKET, bucket_digits, shuffle_key, spare, totals_before

SHARDS = 24
SEED = 20240


def stratified_shards(df: DataFrame, stratum: str = "source", key: str = "doc_id",
                      shards: int = SHARDS, seed: int = SEED, ties: tuple[str, ...] = (),
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard).

    Each stratum is put in a seeded random order; row r of n gets the fraction (r + 1/2) / n. All
    rows in the order of their fractions are cut into equal runs, so shard sizes differ by one row
    at most and each shard has its share of each stratum, give or take a row. The seeded order is
    of the key and `ties` together: with columns of the contents there, rows of one key (or none)
    don't stay together; fully equal rows are interchangeable. A NULL stratum is a stratum. An
    empty table gives no rows. Columns named shard or slot are replaced, others go through.

    Pass only the columns that the shards need: rows cross two exchanges, one by (stratum, bucket
    of the seeded order), one by slice of the fraction, both of about `rows_per_bucket` rows a key
    whatever the size of the largest stratum.
    """
    df = df.drop("shard", "slot")
    order_key, part, bucket, rank, rows, fraction, slice_, place, of = spare(
        df, "_key", "_part", "_bucket", "_rank", "_rows", "_fraction", "_slice", "_place", "_of")
    total = df.count()
    digits = bucket_digits(total, rows_per_bucket)
    slices = max(1, total // rows_per_bucket)
    one = F.lit(1).cast("long")
    keyed = df.withColumn(order_key, shuffle_key(seed, key, *ties)).withColumn(
        bucket, F.substring(order_key, 1, digits)).withColumn(part, F.col(stratum))
    ranked = totals_before(keyed, [part], bucket, [order_key, key, *ties], one, rank)
    sizes = df.groupBy(F.col(stratum).alias(of)).agg(F.count(one).alias(rows))
    placed = (ranked.join(sizes, F.col(part).eqNullSafe(F.col(of))).drop(of)
              .withColumn(fraction, (F.col(rank) + 0.5) / F.col(rows))
              .withColumn(slice_, F.floor(F.col(fraction) * slices)))
    order = [fraction, F.col(part).asc_nulls_last(), rank]
    placed = totals_before(placed, [], slice_, order, one, place)
    return (placed.withColumn("shard", F.floor(F.col(place) * shards / F.lit(total)).cast("int"))
            .withColumn("slot", F.col(place) - first_of("shard", shards, total))
            .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot"))


def first_of(shard: str, shards: int, total: int) -> Column:
    """Place of the first row of a shard: the smallest p with p * shards >= shard * total."""
    return F.expr(f"({shard} * {total}L + {shards - 1}) div {shards}")
