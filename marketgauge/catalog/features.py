"""Queries for the unified table, row-level features and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import features as feat
from ..operators import encoders, explore, joins
from ..operators.joins import lookup
from ..plans.unified import build_features
from ..session import cut
from .registry import q, query, rounded


def rare_sql(col: str, source: str, target: float = 0.95) -> str:
    """CTEs that map each value of a column to itself or 'other'."""
    return f"""
{col}_counts AS (SELECT "{col}" AS v, count(*) AS c FROM {source} GROUP BY 1),
{col}_walk AS (SELECT v, c, row_number() OVER (ORDER BY c DESC, v) - 1 AS pos,
  sum(c) OVER (ORDER BY c DESC, v ROWS UNBOUNDED PRECEDING) / (SELECT sum(c) FROM {col}_counts)
    AS share FROM {col}_counts),
{col}_threshold AS (SELECT coalesce(
  (SELECT c FROM {col}_walk WHERE pos = (SELECT count(*) FROM {col}_walk WHERE share <= {target})),
  (SELECT min(c) FROM {col}_counts)) AS threshold)"""


PREV_SQL = """
firsts AS (SELECT pid, day, arg_min(price, ("lineID", price)) AS price FROM interactions
  GROUP BY pid, day),
prev AS (SELECT pid, day, price - lag(price) OVER (PARTITION BY pid ORDER BY day) AS diff
  FROM firsts)"""

CONTENT_SQL = """CASE WHEN e.content LIKE '%X%' THEN list_product(list_transform(
  string_split(e.content, 'X'), lambda p: trunc(p::DOUBLE)))::DOUBLE
  ELSE try_cast(e.content AS DOUBLE) END"""


@query("features_core", f"""
WITH {rare_sql('manufacturer', 'enriched')}, {rare_sql('group', 'enriched')},
{rare_sql('category', 'enriched')}, {PREV_SQL}
SELECT e."lineID", e.day, e.pid, e."adFlag", e.availability,
  {q('e."competitorPrice"')} AS "competitorPrice", e.click, e.basket, e."order",
  {q('e.price')} AS price, {q('e.revenue')} AS revenue,
  CASE WHEN mc.c < mt.threshold THEN 'other' ELSE e.manufacturer END AS manufacturer,
  CASE WHEN gc.c < gt.threshold THEN 'other' ELSE e."group" END AS "group",
  {CONTENT_SQL} AS content, e.unit,
  coalesce(upper(trim(e."pharmForm")), 'UNKNOWN') AS "pharmForm", e."genericProduct",
  e."salesIndex",
  CASE WHEN cc.c < ct.threshold THEN 'other' ELSE e.category::VARCHAR END AS category,
  {q('e.rrp')} AS rrp, (e."competitorPrice" IS NOT NULL)::INTEGER AS has_competitor,
  coalesce(e."campaignIndex" = 'A', false)::INTEGER AS "campaignIndex_A",
  coalesce(e."campaignIndex" = 'B', false)::INTEGER AS "campaignIndex_B",
  coalesce(e."campaignIndex" = 'C', false)::INTEGER AS "campaignIndex_C",
  {q('e.price - e."competitorPrice"', 2)} AS price_diff_competitor,
  {q('e.price / e."competitorPrice"', 4)} AS price_ratio_competitor,
  {q('(e.price - e."competitorPrice") / e."competitorPrice" * 100', 2)}
    AS price_pct_diff_competitor,
  (e.day >= 26)::INTEGER AS is_post_shift_day,
  {q('p.diff')} AS price_diff_vs_previous_available_day
FROM enriched e
LEFT JOIN manufacturer_counts mc ON mc.v = e.manufacturer CROSS JOIN manufacturer_threshold mt
LEFT JOIN group_counts gc ON gc.v = e."group" CROSS JOIN group_threshold gt
LEFT JOIN category_counts cc ON cc.v = e.category CROSS JOIN category_threshold ct
LEFT JOIN prev p ON p.pid = e.pid AND p.day = e.day
WHERE {CONTENT_SQL} IS NOT NULL""", ("enriched",))
def features_core(t):
    return rounded(build_features(t.interactions, t.items), price_diff_competitor=2,
                   price_ratio_competitor=4, price_pct_diff_competitor=2)


def _item_rows(t, *columns):
    return joins.enrich(feat.null_nonpositive(t.interactions), t.items, list(columns))


@query("competitor_gap", f"""
SELECT "lineID", {q('price - "competitorPrice"', 2)} AS price_diff_competitor,
  {q('price / "competitorPrice"', 4)} AS price_ratio_competitor,
  {q('(price - "competitorPrice") / "competitorPrice" * 100', 2)} AS price_pct_diff_competitor
FROM clean""", ("clean",))
def competitor_gap(t):
    df = feat.competitor_gap(feat.null_nonpositive(t.interactions))
    return df.select("lineID", "price_diff_competitor", "price_ratio_competitor",
                     "price_pct_diff_competitor")


@query("competitor_gap_fraction", f"""
SELECT "lineID", ("competitorPrice" IS NOT NULL)::INTEGER AS has_competitor,
  {q('price / "competitorPrice"')} AS price_ratio_competitor,
  {q('(price - "competitorPrice") / "competitorPrice"')} AS price_pct_diff_competitor
FROM clean""", ("clean",))
def competitor_gap_fraction(t):
    df = feat.competitor_gap(t.interactions, scale="fraction")
    return rounded(df.select("lineID", "has_competitor", "price_ratio_competitor",
                             "price_pct_diff_competitor"))


@query("campaign_onehot", """
SELECT pid, coalesce("campaignIndex" = 'A', false)::INTEGER AS "campaignIndex_A",
  coalesce("campaignIndex" = 'B', false)::INTEGER AS "campaignIndex_B",
  coalesce("campaignIndex" = 'C', false)::INTEGER AS "campaignIndex_C" FROM items""", ("items",))
def campaign_onehot(t):
    return feat.one_hot_fixed(t.items.select("pid", "campaignIndex"), "campaignIndex",
                              schema.CAMPAIGNS)


@query("onehot_drop_first", """
SELECT "lineID", (availability = 2)::INTEGER AS availability_2,
  (availability = 3)::INTEGER AS availability_3, (availability = 4)::INTEGER AS availability_4,
  (unit = 'G')::INTEGER AS "unit_G", (unit = 'ML')::INTEGER AS "unit_ML",
  (unit = 'ST')::INTEGER AS "unit_ST"
FROM enriched""", ("enriched",))
def onehot_drop_first(t):
    df = joins.enrich(t.interactions, t.items, ["unit"]).select("lineID", "availability", "unit")
    return encoders.one_hot(df, ["availability", "unit"], drop_first=True)


SPARSE = ["unit", "manufacturer", "pid"]


@query("onehot_sparse", f"""
WITH cells AS ({" UNION ALL ".join(
    f"""SELECT "lineID", '{c}' AS "column", {i} AS place, {c}::VARCHAR AS v
    FROM enriched WHERE {c} IS NOT NULL""" for i, c in enumerate(SPARSE))})
SELECT "lineID", "column", dense_rank() OVER (ORDER BY place, v) - 1 AS "index" FROM cells""",
       ("enriched",))
def onehot_sparse(t):
    df = joins.enrich(t.interactions, t.items, ["unit", "manufacturer"]).select("lineID", *SPARSE)
    table = encoders.level_table(df, SPARSE)
    hot = encoders.sparse_one_hot(df, SPARSE, table).select("lineID", F.explode("levels")
                                                            .alias("index"))
    # The index tells the column again: the columns' indices follow each other.
    firsts = cut(table.groupBy("column").agg(F.min("index").alias("_first")))
    at = F.lit(None).cast("long")
    for r in firsts.orderBy("_first").collect():
        at = F.when(F.col("index") >= r["_first"], r["_first"]).otherwise(at)
    return joins.lookup(hot.withColumn("_first", at), firsts, ["_first"], stored=True).select(
        "lineID", "column", "index")


@query("price_position", f"""
SELECT "lineID", {q('price / rrp')} AS price_to_rrp_ratio,
  {q('(rrp - price) / rrp')} AS discount_to_rrp_pct,
  {q('ln(greatest(price, 0.01))')} AS log_price,
  {q('ln(price / "competitorPrice")')} AS log_price_ratio,
  coalesce("competitorPrice" > 0 AND price < "competitorPrice", false)::INTEGER
    AS is_cheaper_than_comp,
  coalesce("competitorPrice" > 0 AND price > "competitorPrice", false)::INTEGER
    AS is_more_expensive_than_comp,
  coalesce(price < "competitorPrice", false)::INTEGER AS is_undercutting_competitor,
  {q('abs(round_even((price - "competitorPrice") / "competitorPrice" * 100 * 100, 0) / 100)', 2)}
    AS abs_price_pct_diff_competitor
FROM enriched""", ("enriched",))
def price_position(t):
    df = feat.competitor_gap(_item_rows(t, "rrp"))
    df = feat.abs_gap(feat.price_flags(feat.log_prices(feat.rrp_position(df))))
    return rounded(df.select(
        "lineID", "price_to_rrp_ratio", "discount_to_rrp_pct", "log_price", "log_price_ratio",
        "is_cheaper_than_comp", "is_more_expensive_than_comp", "is_undercutting_competitor",
        "abs_price_pct_diff_competitor"), abs_price_pct_diff_competitor=2)


@query("pack_economics", f"""
WITH sized AS (SELECT e.*, {CONTENT_SQL} AS size FROM enriched e)
SELECT "lineID", {q('price / nullif(size, 0)', 4)} AS unit_price,
  {q('rrp / nullif(size, 0)', 4)} AS unit_rrp,
  {q('"competitorPrice" / nullif(size, 0)', 4)} AS unit_competitor_price,
  {q('(price / nullif(size, 0)) / (rrp / nullif(size, 0))')} AS unit_price_to_rrp_ratio,
  {q('(price / nullif(size, 0)) / ("competitorPrice" / nullif(size, 0))')}
    AS unit_price_to_comp_ratio
FROM sized""", ("enriched",))
def pack_economics(t):
    df = _item_rows(t, "content", "rrp").withColumn("content", feat_content())
    out = feat.pack_economics(df).select(
        "lineID", "unit_price", "unit_rrp", "unit_competitor_price", "unit_price_to_rrp_ratio",
        "unit_price_to_comp_ratio")
    return rounded(out, unit_price=4, unit_rrp=4, unit_competitor_price=4)


def feat_content():
    from ..functions.text import parse_content
    return parse_content("content")


@query("calendar_features", """
SELECT day, count(*) AS n, ((day - 1) % 7 + 1)::INTEGER AS weekday,
  ((day - 1) // 7 + 1)::INTEGER AS week_idx, ((day - 1) // 30 + 1)::INTEGER AS month_idx,
  (day % 7)::INTEGER AS weekday_zero, (day // 7)::INTEGER AS week_zero
FROM interactions GROUP BY day""", ("interactions",))
def calendar_features(t):
    days = t.interactions.groupBy("day").agg(F.count("*").alias("n"))
    return feat.calendar(days).withColumns({
        "weekday_zero": feat.weekday(F.col("day"), base=0, first=0),
        "week_zero": feat.period_index(F.col("day"), 7, base=0, first=0)})


@query("price_category", """
SELECT "lineID", CASE WHEN price < 1 THEN 1 WHEN price < 6 THEN 2 WHEN price < 9.85 THEN 3
  WHEN price < 16.45 THEN 4 WHEN price < 32.125 THEN 5 ELSE 6 END AS price_cat
FROM interactions""", ("interactions",))
def price_category(t):
    return t.interactions.select("lineID", feat.price_category(F.col("price")).alias("price_cat"))


@query("price_interactions", f"""
SELECT "lineID", {q('"adFlag" * (rrp - price) / rrp')} AS ad_x_discount,
  {q('round_even((price - "competitorPrice") * 100, 0) / 100 * availability', 2)}
    AS gap_x_availability
FROM enriched""", ("enriched",))
def price_interactions(t):
    df = feat.rrp_position(feat.competitor_gap(_item_rows(t, "rrp")))
    out = feat.price_interactions(df)
    return rounded(out.select("lineID", "ad_x_discount", "gap_x_availability"),
                   gap_x_availability=2)


@query("daily_cvr", f"""
SELECT "lineID", {q('o / nullif(c, 0)')} AS daily_cvr FROM interactions JOIN
  (SELECT day, sum("order") AS o, sum(click) AS c FROM interactions GROUP BY day) USING (day)""",
       ("interactions",))
def daily_cvr(t):
    joined = lookup(t.interactions.select("lineID", "day"), explore.daily_cvr(t.interactions),
                    ["day"])
    return rounded(joined.select("lineID", "daily_cvr"))


@query("coverage_threshold", f"""
WITH {rare_sql('manufacturer', 'enriched')}, {rare_sql('group', 'enriched')},
{rare_sql('category', 'enriched')}
SELECT 'manufacturer' AS "column", threshold FROM manufacturer_threshold
UNION ALL SELECT 'group', threshold FROM group_threshold
UNION ALL SELECT 'category', threshold FROM category_threshold""", ("enriched",))
def coverage_threshold(t):
    df = joins.enrich(t.interactions, t.items, ["manufacturer", "group", "category"])
    return encoders.coverage_threshold(df, ["manufacturer", "group", "category"])


@query("rare_categories", f"""
WITH {rare_sql('manufacturer', 'enriched', 0.8)}, {rare_sql('category', 'enriched', 0.8)}
SELECT e."lineID",
  CASE WHEN mc.c < mt.threshold THEN 'other' ELSE e.manufacturer END AS manufacturer,
  CASE WHEN cc.c < ct.threshold THEN 'other' ELSE e.category::VARCHAR END AS category
FROM enriched e
LEFT JOIN manufacturer_counts mc ON mc.v = e.manufacturer CROSS JOIN manufacturer_threshold mt
LEFT JOIN category_counts cc ON cc.v = e.category CROSS JOIN category_threshold ct""",
       ("enriched",))
def rare_categories(t):
    df = joins.enrich(t.interactions, t.items, ["manufacturer", "category"]).select(
        "lineID", "manufacturer", "category")
    return encoders.group_rare(df, ["manufacturer", "category"], target=0.8)


@query("onehot_infrequent", """
WITH kept AS (SELECT "pharmForm" AS v FROM enriched WHERE day < 79 AND "pharmForm" IS NOT NULL
  GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM enriched WHERE day < 79))
SELECT CASE WHEN "pharmForm" IN (SELECT v FROM kept) THEN "pharmForm" ELSE '__infrequent__' END
  AS "pharmForm", count(*) AS n
FROM enriched WHERE day >= 79 GROUP BY 1""", ("enriched",))
def onehot_infrequent(t):
    df = joins.enrich(t.interactions, t.items, ["pharmForm"]).select("lineID", "day", "pharmForm")
    merged = encoders.merge_infrequent(df.filter("day < 79"), df.filter("day >= 79"),
                                       ["pharmForm"], 0.05)
    return merged.groupBy("pharmForm").agg(F.count("*").alias("n"))


@query("label_encode", """
SELECT pid, category, "pharmForm",
  CASE WHEN category IS NOT NULL THEN (SELECT count(DISTINCT category::VARCHAR) FROM items j
    WHERE j.category::VARCHAR < i.category::VARCHAR) END AS category_code,
  CASE WHEN "pharmForm" IS NOT NULL THEN (SELECT count(DISTINCT "pharmForm") FROM items j
    WHERE j."pharmForm" < i."pharmForm") END AS "pharmForm_code"
FROM items i""", ("items",))
def label_encode(t):
    df = t.items.select("pid", "category", "pharmForm")
    return encoders.label_encode(df, ["category", "pharmForm"])


@query("factorize", """
WITH firsts AS (SELECT manufacturer, min("lineID") AS f FROM enriched GROUP BY 1)
SELECT "lineID", manufacturer, code AS manufacturer_code FROM enriched JOIN (
  SELECT manufacturer, row_number() OVER (ORDER BY f, manufacturer) - 1 AS code FROM firsts)
USING (manufacturer)""", ("enriched",))
def factorize(t):
    df = joins.enrich(t.interactions, t.items, ["manufacturer"]).select("lineID", "manufacturer")
    return encoders.label_encode(df, ["manufacturer"], order="appearance")


@query("target_encode", f"""
WITH base AS (SELECT "lineID", pid % 5 AS fold, manufacturer AS v, "order" AS y FROM enriched),
folds AS (SELECT fold, count(*) AS fn, sum(y) AS fs FROM base GROUP BY 1),
cells AS (SELECT v, fold, count(*) AS n, sum(y) AS s FROM base GROUP BY 1, 2),
rest AS (SELECT v, c.fold, sum(n) OVER (PARTITION BY v) - n AS n,
  sum(s) OVER (PARTITION BY v) - s AS s,
  (SELECT count(*) FROM base) - fn AS bn, (SELECT sum(y) FROM base) - fs AS bs
  FROM cells c JOIN folds USING (fold)),
means AS (SELECT v, fold, n::DOUBLE AS n, s / nullif(n, 0) AS m, bs / bn AS g FROM rest),
weights AS (SELECT *, n / (n + (m * (1 - m)) / (g * (1 - g))) AS w FROM means)
SELECT "lineID", {q('CASE WHEN n > 0 THEN w * m + (1 - w) * g ELSE g END')} AS manufacturer_te
FROM base JOIN weights USING (v, fold)""", ("enriched",))
def target_encode(t):
    df = joins.enrich(t.interactions, t.items, ["manufacturer"]).select(
        "lineID", "pid", "manufacturer", "order")
    out = encoders.target_encode_cv(df, ["manufacturer"], "order", F.col("pid") % 5)
    return rounded(out.select("lineID", "manufacturer_te"))


@query("target_encode_unseen", f"""
WITH base AS (SELECT day, category::VARCHAR AS v, "order" AS y FROM enriched),
g AS (SELECT avg(y) AS g FROM base WHERE day < 79),
means AS (SELECT v, count(*)::DOUBLE AS n, avg(y) AS m FROM base WHERE day < 79 GROUP BY 1),
weights AS (SELECT v, m, n / (n + (m * (1 - m)) / (g * (1 - g))) AS w FROM means, g)
SELECT b.v AS category, count(*) AS n,
  {q('any_value(coalesce(w * m + (1 - w) * g, g))')} AS category_te
FROM base b CROSS JOIN g LEFT JOIN weights w ON w.v IS NOT DISTINCT FROM b.v
WHERE day >= 79 GROUP BY 1""", ("enriched",))
def target_encode_unseen(t):
    df = joins.enrich(t.interactions, t.items, ["category"]).select("day", "category", "order")
    out = encoders.target_encode(df.filter("day < 79"), df.filter("day >= 79"), ["category"],
                                 "order")
    return rounded(out.groupBy(F.col("category").cast("string").alias("category")).agg(
        F.count("*").alias("n"), F.first("category_te").alias("category_te")))


@query("standardize", f"""
WITH m AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(availability) AS am,
  stddev_pop(availability) AS sa FROM interactions WHERE day < 79)
SELECT "lineID", {q('(price - pm) / ps')} AS price, {q('(availability - am) / sa')}
  AS availability
FROM interactions, m WHERE day >= 79""", ("interactions",))
def standardize(t):
    df = t.interactions.select("lineID", "day", "price", "availability")
    out = encoders.standardize(df.filter("day < 79"), df.filter("day >= 79"),
                               ["price", "availability"])
    return rounded(out.drop("day"))


def spline_sql(knots: int = 5, degree: int = 3) -> str:
    """Cox-de Boor recursion level by level over explicit knots, unlike the piecewise form."""
    n0 = knots + 2 * degree - 1
    levels = ["b0 AS (SELECT id, x, [CASE WHEN (x < hi AND x >= t[i] AND x < t[i + 1]) OR "
              f"(x = hi AND i = {knots - 1 + degree}) THEN 1.0 ELSE 0.0 END "
              f"for i in range(1, {n0 + 1})]::DOUBLE[] AS b, t FROM knotted)"]
    for d in range(1, degree + 1):
        levels.append(
            f"b{d} AS (SELECT id, x, [(x - t[i]) / (t[i + {d}] - t[i]) * b[i] + "
            f"(t[i + {d + 1}] - x) / (t[i + {d + 1}] - t[i + 1]) * b[i + 1] "
            f"for i in range(1, {n0 + 1 - d})] AS b, t FROM b{d - 1})")
    cols = ", ".join(f"{q(f'b[{i + 1}]')} AS price_sp{i}" for i in range(knots + degree - 2))
    return f"""
WITH ends AS (SELECT min(price) AS lo, max(price) AS hi FROM interactions),
knotted AS (SELECT "lineID" AS id, price AS x, hi,
  [lo + (i - {degree + 1}) * ((hi - lo) / {knots - 1}) for i in range(1, {n0 + 2})] AS t
  FROM interactions, ends),
{', '.join(levels)}
SELECT id AS "lineID", {cols} FROM b{degree}"""


@query("spline_basis", spline_sql(), ("interactions",))
def spline_basis(t):
    df = t.interactions.select("lineID", "price")
    return rounded(encoders.spline_basis(df, ["price"]).drop("price"))
