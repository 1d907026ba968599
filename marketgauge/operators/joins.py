"""Left joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, checked_broadcast, cut, cut_counted, row_bytes

HEAVY_SHARE = 0.001
SALTS = 512


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], stored: bool = False,
           max_bytes: int = BROADCAST_BYTES, facts: DataFrame | None = None) -> DataFrame:
    """Left join of a table with one row per key onto the fact rows.

    Broadcast when its counted size allows, else the skew-safe shuffle join. A computed table
    is written once so the count and the join do not compute it twice; pass `stored` for one
    that is read from files.
    """
    if stored:
        most = max_bytes // row_bytes(table)
        return join_counted(df, table, keys, table.limit(most + 1).count(), max_bytes, facts)
    small, rows = cut_counted(table)
    return join_counted(df, small, keys, rows, max_bytes, facts)


def join_counted(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int,
                 max_bytes: int = BROADCAST_BYTES, facts: DataFrame | None = None) -> DataFrame:
    """Left join of a table with one row per key and at most `rows` rows."""
    if rows * row_bytes(table) <= max_bytes:
        return df.join(F.broadcast(table), list(keys), "left")
    return skew_safe_join(df, table, keys, facts=facts)


def skew_safe_join(df: DataFrame, table: DataFrame, keys: Sequence[str],
                   heavy_share: float = HEAVY_SHARE, facts: DataFrame | None = None,
                   ) -> DataFrame:
    """Left join, `table` unique on `keys`, for a `table` too large to broadcast.

    Keys above `heavy_share` of the rows are at most 1 / heavy_share many, so their table rows
    are broadcast; their fact rows, and rows with a NULL key, are spread over salts in the
    shuffle join that serves all other keys. `facts` may name a cheaper table with the same
    keys row for row (the facts `df` was derived from) to count the keys on.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys]
    source = df if facts is None else facts
    counts = source.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = source.agg(F.count("*").alias("n")).scalar()
    heavy_keys = cut(counts.filter(F.col("_n") > total * heavy_share).select(*keys))
    heavy = (table.join(F.broadcast(heavy_keys), keys, "left_semi")
             .select(*keys, F.struct(*values).alias("_heavy"), F.lit(True).alias("_hit")))
    first = df.join(F.broadcast(heavy), keys, "left")  # at most 1 / heavy_share rows
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)) + 1
    first = first.withColumn("_salt", F.when(F.col("_hit") | no_key, spread)
                             .otherwise(F.lit(0).cast("long")))
    light = table.select(*keys, F.lit(0).cast("long").alias("_salt"),
                         F.struct(*values).alias("_light"))
    joined = first.join(light, [*keys, "_salt"], "left")
    return joined.select(*df.columns, *[
        F.when(F.col("_hit"), F.col(f"_heavy.`{c}`")).otherwise(F.col(f"_light.`{c}`")).alias(c)
        for c in values])


def enrich(interactions: DataFrame, items: DataFrame, columns: Sequence[str] | None = None,
           dedupe: bool = False) -> DataFrame:
    """Adds product attributes by pid. A row without a match keeps NULL attributes."""
    if columns is not None:
        items = items.select("pid", *columns)
    if dedupe:
        # One row per pid, chosen by its values so reruns agree.
        rest = [c for c in items.columns if c != "pid"]
        items = (items.groupBy("pid").agg(F.min(F.struct(*rest)).alias("_item"))
                 .select("pid", *[F.col(f"_item.`{c}`").alias(c) for c in rest]))
    return lookup(interactions, items, ["pid"], stored=not dedupe)


def attach(df: DataFrame, features: DataFrame, keys: Sequence[str],
           facts: DataFrame | None = None) -> DataFrame:
    """Merges (key, day) features back on the fact rows."""
    return lookup(df, features, keys, facts=facts)


def enrich_and_attach(df: DataFrame, items: DataFrame, features: DataFrame, keys: Sequence[str],
                      max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of `items` (one row for each value of the first key) and of `features` (one row for
    each value of all keys).

    Where the items may be broadcast, the features alone need an exchange. Else each value of the
    first key becomes one row with its item and, by the other keys, its features, so the wide rows
    cross one exchange instead of two and no item is repeated for each of its days.
    A NULL first key finds nothing; with another key NULL the items are still found.
    """
    first, *others = keys
    values = [c for c in features.columns if c not in keys]
    added = [c for c in items.columns if c not in keys]
    most = max_bytes // row_bytes(items)
    if items.limit(most + 1).count() <= most:
        out = lookup(df.join(F.broadcast(items), first, "left"), features, keys,
                     max_bytes=max_bytes, facts=df)
        return out.select(*df.columns, *added, *values)
    for k in keys:
        features = features.filter(F.col(k).isNotNull())
    place = F.struct(*others)
    pairs = F.collect_list(F.struct(place.alias("at"), F.struct(*values).alias("found")))
    by_first = features.groupBy(first).agg(F.map_from_entries(pairs).alias("_features"))
    small, rows = cut_counted(items.filter(F.col(first).isNotNull()).join(by_first, first, "full"))
    out = join_counted(df, small, [first], rows, max_bytes)
    found = F.try_element_at("_features", place)
    return out.select(*df.columns, *added, *[found[c].alias(c) for c in values])


def unmatched_rows(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Number of fact rows whose pid has no item."""
    known = items.select("pid").distinct().withColumn("_known", F.lit(True))
    return (lookup(interactions.select("pid"), known, ["pid"])
            .agg(F.count("*").alias("rows"),
                 F.count_if(F.col("_known").isNull()).alias("unmatched_rows")))


def orphan_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of `a` that `b` lacks; duplicates collapse before the join."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def membership(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a computed key set."""
    return df.join(checked_broadcast(keys.distinct()), list(on), "left_semi")
