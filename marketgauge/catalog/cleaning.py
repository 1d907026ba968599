"""Queries for sources, projections, filters and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions.features import (action_label, competitor_gap, log_prices, null_nonpositive,
                                  quantity, quantity_rounded)
from ..functions.numbers import finite_or_null, is_present, ratio
from ..functions.text import classify_content, normalize_text, parse_content
from ..operators import cleaning, joins
from ..plans.unified import build_features
from ..session import run_folder
from ..sources import tables as io
from .registry import q, query, rounded

PROFILE = ["lineID", "competitorPrice", "price", "category", "campaignIndex", "pharmForm", "unit"]


@query("preview_hash", """
SELECT least(20, count(*)) AS rows, least(20, count(*)) AS distinct_rows,
  least(20, count(*)) AS known_rows FROM interactions""", ("interactions",))
def preview_hash(t):
    """What holds for any hash: the rows wanted, each once, all from the table."""
    shown = io.preview(t.interactions, 20, ["lineID", "price"], seed=42)
    known = shown.join(t.interactions, ["lineID", "price"], "left_semi")
    return shown.agg(F.count("*").alias("rows"), F.count_distinct("lineID", "price").alias(
        "distinct_rows")).crossJoin(known.agg(F.count("*").alias("known_rows")))


@query("csv_roundtrip", """
SELECT 'interactions' AS source, count(*) AS rows, 0::BIGINT AS differing FROM interactions
UNION ALL SELECT 'items', count(*), 0 FROM items""", ("interactions", "items"))
def csv_roundtrip(t):
    """Both tables written with '|' and read strictly again; rows that are not as before."""
    parts = []
    for name, df, read in (("interactions", t.interactions, io.read_interactions),
                           ("items", t.items, io.read_items)):
        path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        io.write_csv(df, path)
        back = read(df.sparkSession, path)
        changed = back.exceptAll(df.select(*back.columns)).agg(F.count("*").alias("differing"))
        parts.append(back.agg(F.count("*").alias("rows")).crossJoin(changed).select(
            F.lit(name).alias("source"), "rows", "differing"))
    return parts[0].unionByName(parts[1])


@query("schema_profile", """
SELECT * FROM (VALUES
  ('lineID', 'bigint', (SELECT count(*) - count("lineID") FROM e)),
  ('competitorPrice', 'double', (SELECT count(*) - count("competitorPrice") FROM e)),
  ('price', 'double', (SELECT count(*) - count(price) FROM e)),
  ('category', 'int', (SELECT count(*) - count(category) FROM e)),
  ('campaignIndex', 'string', (SELECT count(*) - count("campaignIndex") FROM e)),
  ('pharmForm', 'string', (SELECT count(*) - count("pharmForm") FROM e)),
  ('unit', 'string', (SELECT count(*) - count(unit) FROM e))) v("column", dtype, missing)
""".replace("FROM e)", "FROM enriched)"), ("enriched",))
def schema_profile(t):
    df = joins.enrich(null_nonpositive(t.interactions), t.items)
    return io.schema_profile(df.select(*PROFILE))


@query("parse_content_int", """
SELECT pid, content,
  CASE WHEN content LIKE '%X%' THEN list_product(list_transform(
         string_split(content, 'X'), lambda p: trunc(p::DOUBLE)))::DOUBLE
       ELSE try_cast(content AS DOUBLE) END AS parsed
FROM items""", ("items",))
def parse_content_int(t):
    return t.items.select("pid", "content", parse_content("content").alias("parsed"))


@query("parse_content_float", f"""
SELECT pid, content, {q('''CASE WHEN content LIKE '%X%' THEN list_product(list_transform(
  string_split(content, 'X'), lambda p: p::DOUBLE)) ELSE try_cast(content AS DOUBLE) END''')}
  AS parsed
FROM items""", ("items",))
def parse_content_float(t):
    return rounded(t.items.select("pid", "content", parse_content("content", "float")
                                  .alias("parsed")))


@query("clean_competitor", f"""
SELECT "lineID", price, {q('"competitorPrice"')} AS "competitorPrice",
  ("competitorPrice" IS NOT NULL)::INTEGER AS has_competitor,
  ("competitorPrice" IS NULL)::INTEGER AS competitor_price_missing
FROM (SELECT * REPLACE ({q('price')} AS price) FROM clean)""", ("clean",))
def clean_competitor(t):
    df = null_nonpositive(t.interactions)
    present = is_present("competitorPrice")
    return rounded(df.select("lineID", "price", "competitorPrice",
                             present.alias("has_competitor"),
                             (1 - present).alias("competitor_price_missing")))


@query("normalize_pharmform", """
SELECT pid, coalesce(upper(trim("pharmForm")), 'UNKNOWN') AS "pharmForm" FROM items""",
       ("items",))
def normalize_pharmform(t):
    return t.items.select("pid", normalize_text("pharmForm").alias("pharmForm"))


@query("fill_sentinels", """
SELECT pid, coalesce(category::VARCHAR, 'UNKNOWN') AS category,
  coalesce("pharmForm", 'unknown') AS "pharmForm", coalesce("campaignIndex", 'none')
  AS "campaignIndex" FROM items""", ("items",))
def fill_sentinels(t):
    filled = cleaning.fill_sentinels(t.items, {"category": "UNKNOWN", "pharmForm": "unknown",
                                               "campaignIndex": "none"})
    return filled.select("pid", "category", "pharmForm", "campaignIndex")


@query("finite_or_null", f"""
SELECT "lineID", {q('price')} AS price,
  {q('CASE WHEN "competitorPrice" <> 0 THEN price / "competitorPrice" END')} AS price_ratio
FROM interactions""", ("interactions",))
def finite_or_null_(t):
    # A quotient kept as inf, as a file may hold it, then cleaned.
    raw = F.when(F.col("competitorPrice") == 0, F.lit(float("inf"))).otherwise(
        ratio("price", "competitorPrice"))
    return rounded(finite_or_null(t.interactions.select("lineID", "price",
                                                        raw.alias("price_ratio"))))


@query("impute_median", f"""
SELECT "lineID", price, {q('''coalesce("competitorPrice",
  (SELECT quantile_cont("competitorPrice", 0.5) FROM clean))''')} AS "competitorPrice"
FROM (SELECT * REPLACE ({q('price')} AS price) FROM clean)""", ("clean",))
def impute_median(t):
    df = null_nonpositive(t.interactions).select("lineID", "price", "competitorPrice")
    return rounded(cleaning.impute_median(df, ["competitorPrice"]))


@query("impute_train_median", f"""
SELECT "lineID", day, {q('''coalesce("competitorPrice",
  (SELECT quantile_cont("competitorPrice", 0.5) FROM clean WHERE day < 79))''')}
  AS "competitorPrice"
FROM clean WHERE day >= 79""", ("clean",))
def impute_train_median(t):
    df = null_nonpositive(t.interactions).select("lineID", "day", "competitorPrice")
    train = cleaning.period_filter(df, hi=schema.TEST_DAY - 1)
    test = cleaning.period_filter(df, lo=schema.TEST_DAY)
    return rounded(cleaning.impute_median(test, ["competitorPrice"], fit_on=train))


@query("impute_mode", """
SELECT pid,
  coalesce("pharmForm", (SELECT "pharmForm" FROM items WHERE "pharmForm" IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS "pharmForm",
  coalesce(category::VARCHAR, (SELECT category::VARCHAR FROM items WHERE category IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS category
FROM items""", ("items",))
def impute_mode(t):
    return cleaning.impute_mode(t.items, ["pharmForm", "category"]).select(
        "pid", "pharmForm", "category")


@query("fill_constants", f"""
SELECT "lineID", {q('coalesce("competitorPrice", -999)')} AS "competitorPrice",
  coalesce(category, 0)::INTEGER AS category,
  {q('coalesce(price / nullif("competitorPrice", 0), 1)')} AS price_ratio
FROM enriched""", ("enriched",))
def fill_constants(t):
    df = joins.enrich(null_nonpositive(t.interactions), t.items, ["category"])
    df = df.withColumn("price_ratio", ratio("price", "competitorPrice"))
    filled = df.fillna({"competitorPrice": -999.0, "category": 0, "price_ratio": 1.0})
    return rounded(filled.select("lineID", "competitorPrice", "category", "price_ratio"))


@query("flag_and_fill", f"""
SELECT "lineID", ("competitorPrice" IS NULL)::INTEGER AS "price_ratio_competitor_missing",
  {q('coalesce(price / "competitorPrice", 1)')} AS price_ratio_competitor
FROM clean""", ("clean",))
def flag_and_fill(t):
    df = null_nonpositive(t.interactions).select(
        "lineID", ratio("price", "competitorPrice").alias("price_ratio_competitor"))
    return rounded(cleaning.flag_and_fill(df, "price_ratio_competitor", 1.0))


@query("leakage_drop", f"""
SELECT day, "adFlag", availability, {q('"competitorPrice"')} AS "competitorPrice",
  {q('price')} AS price FROM interactions""", ("interactions",))
def leakage_drop(t):
    return rounded(cleaning.drop_leakage(t.interactions, "actions_no_ids"))


@query("post_shift_period", """
SELECT count(*) AS rows, min(day) AS first_day, max(day) AS last_day,
  count(DISTINCT day) AS days, (SELECT count(*) FROM interactions) AS rows_before
FROM interactions WHERE day >= 26""", ("interactions",))
def post_shift_period(t):
    kept = cleaning.period_filter(t.interactions, lo=schema.SHIFT_DAY)
    before = t.interactions.agg(F.count("*").alias("n")).scalar()
    return kept.agg(F.count("*").alias("rows"), F.min("day").alias("first_day"),
                    F.max("day").alias("last_day"), F.count_distinct("day").alias("days"),
                    F.first(before).alias("rows_before"))


@query("order_quantity", f"""
SELECT "lineID", {q('revenue / price')} AS quantity,
  round_even(revenue / price, 0)::INTEGER AS quantity_rounded
FROM interactions WHERE "order" = 1""", ("interactions",))
def order_quantity(t):
    return rounded(cleaning.orders_only(t.interactions).select(
        "lineID", quantity().alias("quantity"), quantity_rounded().alias("quantity_rounded")))


@query("point_lookup", f"""
SELECT "lineID", pid, day, {q('price')} AS price, {q('"competitorPrice"')} AS "competitorPrice"
FROM interactions WHERE pid = 42 OR "competitorPrice" = 0 OR (pid = 7 AND day = 30)""",
       ("interactions",))
def point_lookup(t):
    hit = ((F.col("pid") == 42) | (F.col("competitorPrice") == 0)
           | ((F.col("pid") == 7) & (F.col("day") == 30)))
    return rounded(t.interactions.filter(hit).select("lineID", "pid", "day", "price",
                                                     "competitorPrice"))


@query("action_label", """
SELECT "lineID", CASE WHEN click = 1 THEN 'click' WHEN basket = 1 THEN 'basket'
  WHEN "order" = 1 THEN 'order' ELSE 'unknown' END AS action FROM interactions""",
       ("interactions",))
def action_label_(t):
    return t.interactions.select("lineID", action_label().alias("action"))


@query("null_unseen", """
SELECT e."lineID", CASE WHEN e.category IN (SELECT category FROM enriched WHERE day < 3
  AND category IS NOT NULL) THEN e.category END AS category,
  CASE WHEN e.unit IN (SELECT unit FROM enriched WHERE day < 3) THEN e.unit END AS unit
FROM enriched e WHERE day >= 3""", ("enriched",))
def null_unseen(t):
    df = joins.enrich(t.interactions, t.items, ["category", "unit"]).select(
        "lineID", "day", "category", "unit")
    train, rest = df.filter("day < 3"), df.filter("day >= 3")
    return cleaning.null_unseen(rest, train, ["category", "unit"]).drop("day")


@query("enrich_interactions", f"""
SELECT c."lineID", c.pid, {q('c.price')} AS price, i.manufacturer, i."group", i.content, i.unit,
  i."salesIndex", i.category, i."campaignIndex", {q('i.rrp')} AS rrp
FROM interactions c LEFT JOIN items i USING (pid)""", ("interactions", "items"))
def enrich_interactions(t):
    df = joins.enrich(t.interactions, t.items, dedupe=True)
    return rounded(df.select("lineID", "pid", "price", "manufacturer", "group", "content", "unit",
                             "salesIndex", "category", "campaignIndex", "rrp"))


@query("unmatched_items", """
SELECT count(*) AS rows, count(*) FILTER (i.pid IS NULL) AS unmatched_rows
FROM interactions c LEFT JOIN (SELECT DISTINCT pid FROM items WHERE "genericProduct" = 0) i
USING (pid)""", ("interactions", "items"))
def unmatched_items(t):
    return joins.unmatched_rows(t.interactions, t.items.filter("genericProduct = 0"))


@query("unmatched_by_all_items", """
SELECT count(*) AS rows, count(*) FILTER (i.pid IS NULL) AS unmatched_rows,
  count(DISTINCT CASE WHEN i.pid IS NULL THEN t.pid END) AS orphan_pids
FROM interactions t LEFT JOIN items i USING (pid)""", ("interactions", "items"))
def unmatched_by_all_items(t):
    orphans = joins.orphan_keys(t.interactions, t.items, "pid").agg(
        F.count("pid").alias("orphan_pids")).scalar()
    return joins.unmatched_rows(t.interactions, t.items).withColumn("orphan_pids", orphans)


@query("orphan_pids", """
SELECT DISTINCT pid FROM interactions
WHERE pid NOT IN (SELECT pid FROM items WHERE "genericProduct" = 0)""",
       ("interactions", "items"))
def orphan_pids(t):
    return joins.orphan_keys(t.interactions, t.items.filter("genericProduct = 0"), "pid")


@query("content_classes", r"""
SELECT pid, CASE WHEN content IS NULL THEN 'missing'
  WHEN regexp_full_match(content, '\d+(\.\d+)?') THEN 'numeric'
  WHEN regexp_full_match(content, '\d+(\.\d+)?([Xx]\d+(\.\d+)?)+') THEN 'multiplier'
  ELSE 'unknown' END AS content_format FROM items""", ("items",))
def content_classes(t):
    return t.items.select("pid", classify_content("content").alias("content_format"))


@query("skew_safe_join", """
SELECT "lineID", manufacturer, unit, category FROM interactions LEFT JOIN items USING (pid)""",
       ("interactions", "items"))
def skew_safe_join(t):
    items = t.items.select("pid", "manufacturer", "unit", "category")
    out = joins.skew_safe_join(t.interactions.select("lineID", "pid"), items, ["pid"],
                               heavy_share=0.0006)
    return out.drop("pid")


@query("features_roundtrip", f"""
SELECT day, count(*) AS n, {q('sum(price)', 2)} AS price_sum FROM enriched
WHERE content NOT IN ('PAK', 'L   125') GROUP BY day""", ("enriched",))
def features_roundtrip(t):
    path = f"{run_folder(t.spark)}/features-{uuid.uuid4().hex}"
    io.write_features(build_features(t.interactions, t.items), path)
    back = io.read_features(t.spark, path)
    return rounded(back.groupBy("day").agg(F.count("*").alias("n"),
                                           F.sum("price").alias("price_sum")), price_sum=2)
