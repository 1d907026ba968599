"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import (ROWS_PER_BUCKET, bucket_digits, shuffle_key, spare, totals_before,
                    word_count)

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_READINGS = 2
SEED = 7041
# Weight over training time, as knots of a piecewise linear curve, for each weight of a source:
# heavy sources fade out, light ones come in late. Only the shape counts, not the scale.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}
NAMES = ("size", "source_size", "target", "taken", "readings")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MAX_READINGS) -> DataFrame:
    """Adds `weight` and `target` to a table of (source, source_size), one row for each source.

    The weights repeat over the sources in code point order, NULL last. `share` times the whole
    size is dealt out by weight; no target exceeds `most` times its source, what is above is dealt
    anew among the others until none is above. That level is found in one pass: by rising capacity
    for each unit of weight, the first source that the level does not fill sets it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    t = (sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                 (place + 1).cast("int")))
         .withColumn("_cap", F.col("source_size") * most))
    ratio = [F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    w = Window.orderBy(*ratio)
    everything = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding,
                                                    Window.unboundedFollowing)
    full = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("_level", (F.lit(share) * F.sum("source_size").over(everything) - full) / left)
    open_ = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))
    t = t.withColumn("_level", F.first(open_, ignorenulls=True).over(everything))
    dealt = F.col("_level") * F.col("weight")
    return (t.withColumn("target", F.when(dealt <= F.col("_cap"), dealt)
                         .otherwise(F.col("_cap").cast("double")))
            .drop("_cap", "_level"))


def curve_time(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time at which the area under a piecewise linear curve reaches `share` of the whole."""
    pieces = list(zip(knots, knots[1:]))
    areas = [(t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in pieces]
    starts = [0.0, *accumulate(areas)]
    reached = share * starts[-1]
    out = F.lit(knots[-1][0])
    for ((t0, v0), (t1, v1)), start, area in reversed(list(zip(pieces, starts, areas))):
        rest = reached - start
        root = F.sqrt(F.greatest(v0 * v0 + 2 * ((v1 - v0) / (t1 - t0)) * rest, F.lit(0.0)))
        at = F.when(rest <= 0, F.lit(t0)).otherwise(t0 + 2 * rest / (v0 + root))
        out = F.when(reached <= start + area, at).otherwise(out)
    return out


def curriculum_mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS,
                   share: float = SHARE, most: int = MAX_READINGS, schedules=SCHEDULES,
                   seed: int = SEED, key: str = "doc_id", whole: bool = False,
                   ties: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET
                   ) -> DataFrame:
    """Adds size, source_size, target, taken and `readings`: array of (position, words).

    Within a source the documents stand in a seeded order; the mix reads on through them, again
    from the first one after the last, until it has the source's target in words. A reading that
    begins after `c` words of its source gets the training position (0 to 1) at which the
    integral of the source's weight schedule reaches c / target. The reading at the edge of the
    target is cut to the words that are left, or with `whole` taken if at least half of it is
    wanted. No document is read more than `most` times.

    NULL text and empty text have size 0, are never taken and have no readings. A NULL source is a
    source. The seeded order is of the key and `ties` together: with columns of the contents there,
    rows of one key (or none) don't stay together; equal rows are interchangeable. An empty table
    gives no rows. Columns of these names in the input are replaced, others go through.
    """
    docs = docs.withColumn(spare(docs, "_size")[0], word_count() if size is None else size)
    counted = docs.columns[-1]
    sized = docs.drop(*[c for c in NAMES if c in docs.columns]).withColumnRenamed(counted, "size")
    order_key, bucket, before, of, weight, demand = spare(
        sized, "_key", "_bucket", "_before", "_of", "_weight", "_demand")
    digits = bucket_digits(docs.count(), rows_per_bucket)
    keyed = sized.withColumn(order_key, shuffle_key(seed, key, *ties)).withColumn(
        bucket, F.substring(order_key, 1, digits))
    earlier = totals_before(keyed, ["source"], bucket, [order_key, key, "size"], F.col("size"),
                            before)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, share, most)
    targets = targets.select(F.col("source").alias(of), F.col("weight").alias(weight),
                             "source_size", "target", F.floor("target").alias(demand))
    joined = earlier.join(targets, F.col("source").eqNullSafe(F.col(of)))
    readings = F.array_compact(F.array(*[
        reading(n, whole, schedules, before, demand, weight) for n in range(most)]))
    words = F.aggregate("readings", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    others = [F.col(f"`{c}`") for c in sized.columns if c != "size"]
    return (joined.withColumn("readings", readings).withColumn("taken", words)
            .select(*others, F.col("size").cast("long").alias("size"), *NAMES[1:]))


def reading(n: int, whole: bool, schedules, before: str, demand: str, weight_: str) -> Column:
    """Reading n of a document: NULL if the source's demand ends before it."""
    start = F.col("source_size") * n + F.col(before)
    wanted = F.col(demand) - start
    words = (F.when(wanted * 2 >= F.col("size"), F.col("size")) if whole
             else F.least(wanted, F.col("size"))).cast("long")
    share = start / F.col("target")
    at = F.when(F.lit(False), F.lit(0.0))
    for weight, knots in schedules.items():
        at = at.when(F.col(weight_) == weight, curve_time(knots, share))
    at = at.otherwise(share)
    return F.when((words > 0) & (F.col("size") > 0),
                  F.struct(at.alias("position"), words.alias("words")))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each reading, with `position` and `words`, range-sorted by position."""
    rows = mixed.withColumn("reading", F.explode("readings")).drop("readings")
    return (rows.withColumn("position", F.col("reading.position"))
            .withColumn("words", F.col("reading.words")).drop("reading")
            .orderBy("position", "source", "doc_id"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents as the mix reads them, in training order: a document that is read twice is
    there twice, one that is not read is gone. Documents are read whole.

    The mix is made from keys, sources, sizes and codes of whole rows; texts cross one exchange to
    meet their readings and one to be range-sorted by position. Equal rows are counted, and one of
    them stands for all in what is read; rows of one key (or none) are told apart by their codes.
    """
    columns = docs.columns
    one, two = spare(docs, "_one", "_two")
    marked = docs.withColumn(one, F.xxhash64(*columns)).withColumn(two, F.xxhash64(
        F.lit(1), *columns))
    # Sizes are taken before the exchange: no text crosses it for them.
    small = marked.select(F.col(key).alias("id"), "source", F.col(one).alias("one"),
                          F.col(two).alias("two"), word_count().alias("words"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    small = (small.groupBy("id", "source", "one", "two", "words").agg(
        F.count("*").alias("copies")).withColumn("copy", copies).drop("copies"))
    read = curriculum_mix(small, size=F.col("words"), key="id", whole=True,
                          ties=("one", "copy"), **settings)
    at, read_one, read_two = spare(marked, "_at", "_of_one", "_of_two")
    read = read.select(F.col("one").alias(read_one), F.col("two").alias(read_two),
                       F.explode("readings.position").alias(at))
    each = marked.dropDuplicates([one, two])
    both = each.join(read, (F.col(one) == F.col(read_one)) & (F.col(two) == F.col(read_two)))
    return both.orderBy(at, "source", key, one).select(*[F.col(f"`{c}`") for c in columns])
