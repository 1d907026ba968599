"""Exact-size samples, splits and folds by hash rank.

Rows are ordered by a hash of their key. Instead of sorting a stratum, rows are counted per
(stratum, top hash bits); buckets that a cut falls into are counted again by their next bits until
few rows are left in them. These are ranked, and the resulting threshold keys, a handful per
stratum, decide every row where it lies. A stratum that holds a third of all rows costs the same as
any other, and wide rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import period_index
from ..session import checked_broadcast, cut
from ..sources.tables import require_columns

ROW_KEY = ("lineID", "price")
HASH_BITS = 12
MOST_RANKED = 100_000  # rows of a bucket that are ranked in one task


def order_key(keys: Sequence[str], seed: int) -> Column:
    """A total, seeded pseudo-random order; `keys` identify a row."""
    return F.struct(_hash(keys, seed).alias("h"), *[F.col(k) for k in keys])


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _before(t: Column, keys: Sequence[str], seed: int) -> Column:
    """Whether the order key `t` comes before the row's own, field by field."""
    result = F.lit(False)
    for name in reversed(keys):
        field = t.getField(name)
        result = (field < F.col(name)) | ((field == F.col(name)) & result)
    own = _hash(keys, seed)
    return (t.getField("h") < own) | ((t.getField("h") == own) & result)


def _bucket(key: Column, bits: int) -> Column:
    return F.shiftright(key.getField("h"), 64 - bits)


def join_strata(left: DataFrame, right: DataFrame, columns: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL: a NULL stratum is a stratum."""
    named = {c: f"_on_{c}" for c in columns}
    right = right.withColumnsRenamed(named)
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()]
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*named.values())


def rank_thresholds(df: DataFrame, strata: Sequence[str], cuts: DataFrame, keys: Sequence[str],
                    seed: int, bits: int = HASH_BITS, most: int = MOST_RANKED) -> DataFrame:
    """(strata.., thresholds[], below_first): the order key of the row at each `cut_rank`
    (1-based) of its stratum. Rank 0 has no row; such cuts are counted in `below_first`.

    Radix selection: each level counts the buckets of `bits` more hash bits inside those that hold
    a cut, at most 2^bits of them for a cut, until no such bucket has more than `most` rows (or
    the hash is used up: rows of one key)."""
    strata = list(strata)
    tagged = df.select(*strata, order_key(keys, seed).alias("_k"))
    wanted = cuts.filter(F.col("cut_rank") > 0)
    zero = F.lit(0).cast("long")
    inside = tagged.withColumns({"_up": zero, "_from": zero})
    width = bits
    while True:
        rows = inside.withColumn("_b", _bucket(F.col("_k"), width))
        counts = rows.groupBy(*strata, "_up", "_from", "_b").agg(F.count("*").alias("_n"))
        run = Window.partitionBy(*strata, "_up").orderBy("_b")
        spans = counts.withColumn("_end", F.col("_from") + F.sum("_n").over(run))
        spans = spans.withColumn("_start", F.col("_end") - F.col("_n")).drop("_up", "_from")
        hits = cut(join_strata(spans, wanted, strata)
                   .filter((F.col("_start") < F.col("cut_rank"))
                           & (F.col("cut_rank") <= F.col("_end")))
                   .select(*strata, "_b", "_start", "_n", "cut_rank"))
        edges = checked_broadcast(hits.select(*strata, "_b", "_start").distinct())
        largest = hits.agg(F.max("_n").alias("n")).first().n or 0
        if largest <= most or width + bits > 64:
            break
        up = edges.withColumnsRenamed({"_b": "_up", "_start": "_from"})
        inside = join_strata(tagged.withColumn("_up", _bucket(F.col("_k"), width)), up,
                             [*strata, "_up"])
        width += bits
    order = Window.partitionBy(*strata, "_b").orderBy("_k")
    ranked = (join_strata(tagged.withColumn("_b", _bucket(F.col("_k"), width)), edges,
                          [*strata, "_b"])
              .withColumn("cut_rank", F.col("_start") + F.row_number().over(order)))
    found = (join_strata(ranked, hits.select(*strata, "cut_rank"), [*strata, "cut_rank"])
             .groupBy(*strata).agg(F.sort_array(F.collect_list("_k")).alias("thresholds")))
    zero = cuts.groupBy(*strata).agg(F.count_if(F.col("cut_rank") == 0).alias("below_first"))
    return join_strata(zero, found, strata, "left")


def label_by_rank(df: DataFrame, strata: Sequence[str], cuts: DataFrame, keys: Sequence[str],
                  seed: int, name: str, bits: int = HASH_BITS) -> DataFrame:
    """Adds `name`: how many cuts of its stratum a row lies behind. With cuts r1 < r2 the rows
    ranked 1..r1 get 0, r1+1..r2 get 1, the rest 2. Each (stratum, cut_rank) must be distinct
    above rank 0."""
    thresholds = checked_broadcast(rank_thresholds(df, strata, cuts, keys, seed, bits))
    behind = F.coalesce(F.size(F.filter("thresholds", lambda t: _before(t, keys, seed))),
                        F.lit(0))
    behind = F.when(F.col("thresholds").isNull(), 0).otherwise(behind)
    return (join_strata(df, thresholds, list(strata), "left")
            .withColumn(name, (F.coalesce("below_first", F.lit(0)) + behind).cast("int"))
            .drop("thresholds", "below_first"))


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return cut(df.groupBy(*strata).agg(F.count("*").alias("rows")))


def largest_remainder(sizes: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """(strata.., rows, quota): `n` split over the strata in proportion to their rows; whole
    parts first, then one more for the largest fractions (ties by stratum)."""
    # `sizes` has one row per stratum, so its window is as small as the strata.
    everything = Window.partitionBy()
    share = sizes.withColumn("_exact", F.col("rows") * F.lit(float(n))
                             / F.sum("rows").over(everything))
    share = share.withColumn("_whole", F.floor("_exact"))
    left = F.lit(n) - F.sum("_whole").over(everything)
    place = F.row_number().over(
        Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_whole"), 9)), *strata))
    return (share.withColumns({"_left": left, "_place": place})
            .withColumn("quota", (F.col("_whole") + F.when(F.col("_place") <= F.col("_left"), 1)
                                  .otherwise(0)).cast("long"))
            .select(*strata, "rows", "quota"))


def sample_strata(df: DataFrame, n: int) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows allowed, strata, sizes) for a sample of `n`: order x 7-day week over strata of at
    least 2 rows when enough rows and strata remain, else order alone."""
    require_columns(df, ["order"])
    if "day" in df.columns:
        weekly = df.withColumn("week", period_index(F.col("day"), 7, base=0, first=0))
        strata = ["order", "week"]
        sizes = stratum_sizes(weekly, strata).filter(F.col("rows") >= 2)
        enough = sizes.agg(F.sum("rows").alias("n"), F.count("*").alias("k")).first()
        if (enough.n or 0) >= n and enough.k > 1:
            return weekly, strata, sizes
    return df, ["order"], stratum_sizes(df, ["order"])


def stratified_sample(df: DataFrame, n: int, keys: Sequence[str] = ROW_KEY,
                      seed: int = 42) -> DataFrame:
    """Exactly `n` rows (or the whole table if smaller) keeping order and week proportions."""
    if fits_whole(df, n):
        return df
    rows, strata, sizes = sample_strata(df, n)
    quotas = cut(largest_remainder(sizes, strata, n))
    cuts = quotas.select(*strata, F.col("quota").alias("cut_rank"))
    labelled = label_by_rank(rows, strata, cuts, keys, seed, "_side")
    # Strata left out of the quotas are left out of the sample.
    kept = join_strata(labelled, F.broadcast(quotas.select(*strata)), strata, "left_semi")
    return kept.filter(F.col("_side") == 0).select(*df.columns)


def fits_whole(df: DataFrame, n: int) -> bool:
    return df.count() <= n


def random_sample(df: DataFrame, n: int, keys: Sequence[str] = ROW_KEY,
                  seed: int = 42) -> DataFrame:
    """Exactly `n` seeded random rows, for any `n`."""
    one = df.withColumn("_all", F.lit(0))
    cuts = df.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(n).alias("cut_rank"))
    cuts = cuts.withColumn("cut_rank", F.least(
        F.col("cut_rank").cast("long"), df.agg(F.count("*").alias("n")).scalar()))
    labelled = label_by_rank(one, ["_all"], cuts, keys, seed, "_side")
    return labelled.filter(F.col("_side") == 0).select(*df.columns)


def stratified_split(df: DataFrame, label: str, test_share: float = 0.2,
                     keys: Sequence[str] = ROW_KEY, seed: int = 42) -> DataFrame:
    """Adds `split` ("train" / "test"): the test side has ceil(share x rows) rows in total,
    spread over the label values in proportion."""
    sizes = stratum_sizes(df, [label])
    total = sizes.agg(F.sum("rows").alias("n")).first().n or 0
    n_test = -int(-(total * test_share) // 1)
    cuts = largest_remainder(sizes, [label], n_test).select(
        label, F.col("quota").alias("cut_rank"))
    sided = label_by_rank(df, [label], cut(cuts), keys, seed, "_side")
    return (sided.withColumn("split", F.when(F.col("_side") == 0, "test").otherwise("train"))
            .drop("_side"))


def split_drift(split: DataFrame, label: str) -> DataFrame:
    """Mean label per side and their distance from the overall mean."""
    overall = split.agg(F.avg(label).alias("m")).scalar()
    return split.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(label).alias("rate"),
        F.abs(F.avg(label) - F.first(overall)).alias("drift"))


def random_split(df: DataFrame, test_share: float = 0.2, keys: Sequence[str] = ROW_KEY,
                 seed: int = 42) -> DataFrame:
    """Adds `split` by a hash threshold: no shuffle, stable under any input order."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(unit < test_share, "test").otherwise("train"))


def kfold(df: DataFrame, label: str, k: int = 5, keys: Sequence[str] = ROW_KEY,
          seed: int = 42) -> DataFrame:
    """Adds `fold` 0..k-1; within a label value the folds differ by at most one row."""
    sizes = stratum_sizes(df, [label])
    n, i = F.col("rows"), F.col("i")
    # Fold j ends at rank j * (n div k) + min(j, n mod k).
    ends = F.floor(n / k) * i + F.least(i, n % k)
    cuts = (sizes.select(label, "rows", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("i"))
            .select(label, ends.cast("long").alias("cut_rank")))
    first = cuts.filter(F.col("cut_rank") == 0)
    rest = cuts.filter(F.col("cut_rank") > 0).distinct()
    return label_by_rank(df, [label], first.unionByName(rest), keys, seed, "fold")


def time_split(df: DataFrame, cuts: Sequence[int], names: Sequence[str] | None = None,
               ) -> DataFrame:
    """Adds `split` by day: before the first cut, between cuts, from the last cut."""
    names = names or (["train", "test"] if len(cuts) == 1 else ["train", "valid", "test"])
    split = F.when(F.col("day") < cuts[0], names[0])
    for day, name in zip(cuts[1:], names[1:]):
        split = split.when(F.col("day") < day, name)
    return df.withColumn("split", split.otherwise(names[-1]))


def day_share_split(df: DataFrame, shares: Sequence[float], names: Sequence[str] | None = None,
                    ) -> DataFrame:
    """Adds `split` at whole-number positions int(days x share) of the sorted distinct days."""
    days = [r.day for r in df.select("day").distinct().orderBy("day").collect()]
    cuts = [days[int(len(days) * s)] if int(len(days) * s) < len(days) else days[-1] + 1
            for s in shares]
    return time_split(df, cuts, names)


def oversample(df: DataFrame, label: str, keys: Sequence[str] = ROW_KEY,
               seed: int = 42) -> DataFrame:
    """Repeats rows until every label value has as many as the largest one: each row the whole
    part of the ratio, and the remainder to the first rows in hash order."""
    sizes = stratum_sizes(df, [label])
    largest = sizes.agg(F.max("rows").alias("m")).scalar()
    plan = cut(sizes.select(label, F.floor(largest / F.col("rows")).alias("_copies"),
                            (largest % F.col("rows")).alias("cut_rank")))
    sided = label_by_rank(df, [label], plan.select(label, "cut_rank"), keys, seed, "_side")
    # One row per label value.
    counted = join_strata(sided, F.broadcast(plan.select(label, "_copies")), [label])
    copies = F.col("_copies") + F.when(F.col("_side") == 0, 1).otherwise(0)
    return (counted.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
            .select(*df.columns, "copy"))


def hash_ranks(df: DataFrame, keys: Sequence[str], seed: int, bits: int | None = None,
               name: str = "rank") -> DataFrame:
    """Adds a 1-based rank in hash order, ranked per hash bucket (equal sizes by design, about
    MOST_RANKED rows at most unless `bits` are given)."""
    if bits is None:
        bits = max(HASH_BITS, (df.count() // MOST_RANKED).bit_length())
    tagged = df.withColumn("_k", order_key(keys, seed))
    tagged = tagged.withColumn("_b", _bucket(F.col("_k"), bits))
    # At most 2^bits rows.
    counts = tagged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy("_k")
    return (tagged.join(checked_broadcast(offsets), "_b")
            .withColumn(name, F.col("_off") + F.row_number().over(inside))
            .drop("_k", "_b", "_off"))
