"""Queries for profiles, funnels, daily series, price bins and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions.features import competitor_gap, null_nonpositive, rrp_position
from ..operators import cleaning, explore, joins
from .registry import q, query, rounded

COLUMNS = ["lineID", "day", "pid", "competitorPrice", "price", "category", "campaignIndex",
           "pharmForm"]


def _clean(t):
    return null_nonpositive(t.interactions)


def _joined(t, *columns):
    return joins.enrich(_clean(t), t.items, list(columns))


def _each(columns, template: str) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in columns)


# ---- missing values, keys, distinct values ----

@query("missing_summary", f"""
SELECT * FROM ({_each(COLUMNS, '''SELECT '{c}' AS "column", count(*) - count("{c}") AS missing,
  ''' + q('100.0 * (count(*) - count("{c}")) / count(*)') + ''' AS missing_pct FROM enriched''')})
WHERE missing > 0""", ("enriched",))
def missing_summary(t):
    df = _joined(t, "category", "campaignIndex", "pharmForm").select(*COLUMNS)
    return rounded(explore.missing_summary(df))


@query("row_missing", f"""
WITH r AS (SELECT 100.0::DOUBLE * (("competitorPrice" IS NULL)::INT + (category IS NULL)::INT
  + ("campaignIndex" IS NULL)::INT + ("pharmForm" IS NULL)::INT) / 8 AS p FROM enriched)
SELECT count(*) AS rows, {q('avg(p)')} AS mean, {q('stddev_samp(p)')} AS std,
  {q('min(p)')} AS min, {q('quantile_cont(p, 0.25)')} AS q1, {q('quantile_cont(p, 0.5)')} AS median,
  {q('quantile_cont(p, 0.75)')} AS q3, {q('max(p)')} AS max,
  count(*) FILTER (p > 0) AS rows_with_missing FROM r""", ("enriched",))
def row_missing(t):
    df = _joined(t, "category", "campaignIndex", "pharmForm").select(*COLUMNS)
    return rounded(explore.row_missing(df))


@query("distinct_profile", _each(COLUMNS, """
SELECT '{c}' AS "column", count(DISTINCT "{c}") AS n_distinct FROM enriched"""), ("enriched",))
def distinct_profile(t):
    df = _joined(t, "category", "campaignIndex", "pharmForm")
    return explore.distinct_profile(df, COLUMNS)


@query("distinct_values", """
SELECT DISTINCT 'unit' AS "column", unit AS value FROM items
UNION ALL SELECT DISTINCT 'salesIndex', "salesIndex"::VARCHAR FROM items
UNION ALL SELECT DISTINCT 'campaignIndex', "campaignIndex" FROM items
  WHERE "campaignIndex" IS NOT NULL""", ("items",))
def distinct_values(t):
    return explore.distinct_values(t.items, ["unit", "salesIndex", "campaignIndex", "pid"], 10)


@query("key_audit", """
SELECT 'items.pid' AS key, count(*) AS rows, count(*) - count(pid) AS missing,
  count(DISTINCT pid) AS n_distinct, count(pid) - count(DISTINCT pid) AS duplicates,
  (count(*) = count(DISTINCT pid))::INTEGER AS is_unique FROM items
UNION ALL SELECT 'items.category', count(*), count(*) - count(category), count(DISTINCT category),
  count(category) - count(DISTINCT category), (count(*) = count(DISTINCT category))::INTEGER
FROM items""", ("items",))
def key_audit(t):
    def one(key):
        return explore.key_audit(t.items, key).select(F.lit(f"items.{key}").alias("key"), "*")
    return one("pid").unionByName(one("category"))


@query("action_exclusivity", """
SELECT (click + basket + "order")::INTEGER AS action_sum, count(*) AS rows
FROM interactions GROUP BY 1""", ("interactions",))
def action_exclusivity(t):
    return explore.action_exclusivity(t.interactions)


@query("valid_actions", """
SELECT CASE WHEN click = 1 THEN 'click' WHEN basket = 1 THEN 'basket' ELSE 'order' END AS action,
  count(*) AS n FROM interactions WHERE click + basket + "order" = 1 GROUP BY 1""",
       ("interactions",))
def valid_actions(t):
    return cleaning.valid_actions(t.interactions).groupBy("action").agg(F.count("*").alias("n"))


@query("revenue_by_order", f"""
SELECT "order", {q('min(revenue)')} AS min, {q('max(revenue)')} AS max,
  {q('avg(revenue)')} AS mean, {q('quantile_cont(revenue, 0.5)')} AS median
FROM interactions GROUP BY 1""", ("interactions",))
def revenue_by_order(t):
    return rounded(explore.revenue_check(t.interactions))


@query("class_balance", _each(schema.ACTIONS, f"""
SELECT '{{c}}' AS action, sum("{{c}}")::BIGINT AS n, {q('avg("{c}")')} AS share
FROM interactions"""), ("interactions",))
def class_balance(t):
    return rounded(explore.class_balance(t.interactions))


@query("purchase_funnel", f"""
SELECT {q('100.0 * sum(click) / count(*)')} AS browsed_only_pct,
  {q('100.0 * sum(basket + "order") / count(*)')} AS intent_pct,
  {q('100.0 * sum("order") / count(*)')} AS purchase_pct,
  {q('100.0 * sum("order") / sum(basket + "order")')} AS intent_to_order_pct
FROM interactions""", ("interactions",))
def purchase_funnel(t):
    return rounded(explore.funnel(t.interactions))


@query("funnel_by_ad", f"""
SELECT "adFlag", count(*) AS impression, sum(click)::BIGINT AS click,
  sum(basket)::BIGINT AS basket, sum("order")::BIGINT AS "order",
  {q('avg(click)')} AS click_rate, {q('avg(basket)')} AS basket_rate,
  {q('avg("order")')} AS order_rate FROM interactions GROUP BY 1""", ("interactions",))
def funnel_by_ad(t):
    return rounded(explore.funnel(t.interactions, ["adFlag"]))


@query("event_funnel", f"""
SELECT event_type, count(*) AS n, {q('count(*) / (SELECT count(*) FROM events)')} AS share
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def event_funnel(t):
    return rounded(explore.event_funnel(t.table("events"), ["view", "click", "purchase"]))


# ---- numeric descriptions ----

def describe_sql(c: str, source: str) -> str:
    return f"""
SELECT '{c}' AS "column", count("{c}") AS count, {q(f'avg("{c}")', 4)} AS mean,
  {q(f'stddev_samp("{c}")', 4)} AS std, {q(f'min("{c}")')} AS min,
  {q(f'quantile_cont("{c}"::DOUBLE, 0.25)')} AS q1,
  {q(f'quantile_cont("{c}"::DOUBLE, 0.5)')} AS median,
  {q(f'quantile_cont("{c}"::DOUBLE, 0.75)')} AS q3, {q(f'max("{c}")')} AS max FROM {source}"""


PRICES = ["price", "competitorPrice", "rrp"]


@query("describe_prices", "\nUNION ALL\n".join(describe_sql(c, "enriched") for c in PRICES),
       ("enriched",))
def describe_prices(t):
    return rounded(explore.describe_numeric(_joined(t, "rrp"), PRICES), mean=4, std=4)


@query("box_stats", f"""
SELECT "column", n, missing, min, q1, {q('mean', 4)} AS mean, median, q3, max,
  {q('q1 - 1.5 * (q3 - q1)', 5)} AS lower_fence, {q('q3 + 1.5 * (q3 - q1)', 5)} AS upper_fence
FROM (SELECT 'price' AS "column", count(price) AS n, count(*) - count(price) AS missing,
  {q('min(price)')} AS min, {q('quantile_cont(price, 0.25)')} AS q1, avg(price) AS mean,
  {q('quantile_cont(price, 0.5)')} AS median, {q('quantile_cont(price, 0.75)')} AS q3,
  {q('max(price)')} AS max FROM interactions)""", ("interactions",))
def box_stats(t):
    return rounded(explore.box_stats(t.interactions, ["price"]), mean=4, lower_fence=5,
                   upper_fence=5)


@query("iqr_outliers", _each(["price", "competitorPrice"], f"""
SELECT '{{c}}' AS "column", {q('any_value(lo)', 5)} AS lower, {q('any_value(hi)', 5)} AS upper,
  count(*) FILTER ("{{c}}" < lo OR "{{c}}" > hi) AS outliers,
  {q('100.0 * count(*) FILTER ("{c}" < lo OR "{c}" > hi) / count("{c}")')} AS outlier_pct
FROM clean, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (
  SELECT quantile_cont("{{c}}", 0.25) AS a, quantile_cont("{{c}}", 0.75) AS b FROM clean))"""),
       ("clean",))
def iqr_outliers(t):
    return rounded(explore.iqr_outliers(_clean(t), ["price", "competitorPrice"]), lower=5,
                   upper=5)


@query("competitor_gap_stats",
       "WITH gaps AS (SELECT round_even((price - \"competitorPrice\") * 100, 0) / 100 AS "
       "price_diff_competitor FROM clean)" + describe_sql("price_diff_competitor", "gaps"),
       ("clean",))
def competitor_gap_stats(t):
    df = competitor_gap(_clean(t))
    return rounded(explore.describe_numeric(df, ["price_diff_competitor"]), mean=4, std=4)


@query("quantity_profile",
       "WITH qty AS (SELECT revenue / price AS quantity FROM interactions WHERE \"order\" = 1), "
       "cap AS (SELECT quantile_cont(quantity, 0.99) AS p99 FROM qty), "
       f"""d AS ({describe_sql('quantity', 'qty')})
SELECT d.*, s.* FROM d, (SELECT {q('avg((quantity = 1)::INT)')} AS single_unit_share,
  {q('any_value(p99)')} AS p99, count(*) FILTER (quantity > p99) AS above_p99 FROM qty, cap) s""",
       ("interactions",))
def quantity_profile(t):
    return rounded(explore.quantity_profile(t.interactions), mean=4, std=4)


@query("quantity_classes", f"""
WITH o AS (SELECT round_even(revenue / price, 0)::INTEGER AS u FROM interactions
  WHERE "order" = 1),
c AS (SELECT CASE WHEN u <= 3 THEN u::VARCHAR WHEN u <= 5 THEN '4-5' ELSE '6+' END AS k FROM o)
SELECT p::INTEGER AS position, v AS quantity_class, count(k) AS n,
  {q('100.0 * count(k) / (SELECT count(*) FROM o)')} AS pct
FROM (VALUES (0, '1'), (1, '2'), (2, '3'), (3, '4-5'), (4, '6+')) a(p, v)
LEFT JOIN c ON c.k = a.v GROUP BY 1, 2""", ("interactions",))
def quantity_classes(t):
    return rounded(explore.quantity_class_counts(t.interactions))


@query("price_sanity", """
SELECT count(*) FILTER ("competitorPrice" = 0) AS competitor_zero,
  count(*) FILTER ("competitorPrice" IS NULL) AS competitor_missing,
  coalesce(bool_or(price < 1), false)::INTEGER AS any_price_below_1 FROM interactions""",
       ("interactions",))
def price_sanity(t):
    return explore.price_sanity(t.interactions)


@query("price_skewness", _each(PRICES, f"""
SELECT '{{c}}' AS "column", {q('(avg("{c}" * "{c}" * "{c}") - 3 * avg("{c}") * avg("{c}" * "{c}") + 2 * avg("{c}") ** 3) / var_pop("{c}") ** 1.5')}
  AS skewness FROM enriched"""), ("enriched",))
def price_skewness(t):
    return rounded(explore.skewness(_joined(t, "rrp"), PRICES))


# ---- rates by group ----

@query("value_counts", f"""
SELECT category, count(*) AS n, {q('100.0 * count(*) / (SELECT count(*) FROM enriched)')} AS pct
FROM enriched GROUP BY 1""", ("enriched",))
def value_counts(t):
    return rounded(explore.value_counts(_joined(t, "category"), "category", dropna=False))


@query("order_rate_by_flag", f"""
SELECT "adFlag", count(*) AS n, {q('avg("order")')} AS order_rate FROM interactions GROUP BY 1""",
       ("interactions",))
def order_rate_by_flag(t):
    return rounded(explore.order_rate_by(t.interactions, "adFlag"))


@query("order_rate_by_category", f"""
SELECT category, count(*) AS n, {q('avg("order")')} AS order_rate FROM enriched
WHERE category IS NOT NULL GROUP BY 1""", ("enriched",))
def order_rate_by_category(t):
    return rounded(explore.order_rate_by(_joined(t, "category"), "category"))


@query("order_rate_campaign_none", f"""
SELECT coalesce("campaignIndex", 'None') AS "campaignIndex", count(*) AS n,
  {q('avg("order")')} AS order_rate FROM enriched GROUP BY 1""", ("enriched",))
def order_rate_campaign_none(t):
    return rounded(explore.order_rate_by(_joined(t, "campaignIndex"), "campaignIndex",
                                         null_label="None"))


@query("top_manufacturers", f"""
SELECT manufacturer, count(*) AS interactions, {q('avg("order")')} AS order_rate,
  {q('count(*) / (SELECT count(*) FROM enriched)')} AS coverage
FROM enriched WHERE manufacturer IS NOT NULL GROUP BY 1
ORDER BY interactions DESC, manufacturer LIMIT 10""", ("enriched",))
def top_manufacturers(t):
    return rounded(explore.top_values(_joined(t, "manufacturer"), "manufacturer"))


@query("top_prices", f"""
SELECT "lineID", pid, day, {q('price')} AS price FROM interactions
ORDER BY interactions.price DESC, "lineID" LIMIT 10""", ("interactions",))
def top_prices(t):
    df = t.interactions.select("lineID", "pid", "day", "price")
    return rounded(explore.top_n(df, "price", 10, ["lineID"]))


@query("group_sizes", """
SELECT "group", count(*) AS n, sum("order")::BIGINT AS orders,
  count(*) FILTER ("order" = 0) AS others FROM enriched WHERE "group" IS NOT NULL GROUP BY 1""",
       ("enriched",))
def group_sizes(t):
    return explore.group_sizes(_joined(t, "group"), "group")


SEGMENT = f"""count(*) AS n, {q('avg("order")')} AS order_rate, {q('avg(price)', 4)} AS avg_price,
  {q('avg(revenue)', 4)} AS avg_revenue"""


@query("availability_ad_segments", f"""
SELECT availability, "adFlag", {SEGMENT},
  {q('avg((price - "competitorPrice") / "competitorPrice")')} AS avg_price_gap_pct
FROM clean GROUP BY 1, 2""", ("clean",))
def availability_ad_segments(t):
    df = competitor_gap(t.interactions, scale="fraction")
    return rounded(explore.segment_summary(df, ["availability", "adFlag"]), avg_price=4,
                   avg_revenue=4)


@query("competitor_presence", f"""
SELECT ("competitorPrice" IS NOT NULL)::INTEGER AS has_competitor, {SEGMENT}
FROM clean GROUP BY 1""", ("clean",))
def competitor_presence(t):
    df = competitor_gap(t.interactions, scale="fraction").drop("price_pct_diff_competitor")
    return rounded(explore.segment_summary(df, ["has_competitor"]), avg_price=4, avg_revenue=4)


@query("category_sensitivity", f"""
SELECT category, count(*) AS n, {q('avg("order")')} AS order_rate,
  {q('corr((price - "competitorPrice") / "competitorPrice", "order")')} AS corr_gap_vs_order
FROM enriched WHERE category IS NOT NULL GROUP BY 1 HAVING count(*) >= 1000""", ("enriched",))
def category_sensitivity(t):
    df = competitor_gap(_joined(t, "category"), scale="fraction")
    return rounded(explore.category_sensitivity(df))


BUCKETS_SQL = f"""
WITH gaps AS (SELECT *, (price - "competitorPrice") / "competitorPrice" AS g FROM enriched),
binned AS (SELECT *, CASE WHEN g <= -0.2 THEN 'much_cheaper' WHEN g <= -0.1 THEN 'cheaper'
  WHEN g <= -0.05 THEN 'slightly_cheaper' WHEN g <= 0.05 THEN 'at_market'
  WHEN g <= 0.1 THEN 'slightly_more_expensive' WHEN g <= 0.2 THEN 'more_expensive'
  WHEN g > 0.2 THEN 'much_more_expensive' END AS bucket FROM gaps),
axis AS (SELECT unnest([{', '.join(repr(b) for b in schema.POSITION_LABELS)}]) AS bucket),
summary AS (SELECT bucket, count(b."lineID") AS n, {q('avg("order")')} AS order_rate,
  {q('avg(price)', 4)} AS avg_price, {q('avg("competitorPrice")', 4)} AS avg_competitor_price,
  {q('avg(revenue)', 4)} AS avg_revenue, {q('avg((rrp - price) / rrp)')}
  AS avg_discount_to_rrp_pct FROM axis LEFT JOIN binned b USING (bucket) GROUP BY 1)"""


def _buckets(t):
    df = competitor_gap(rrp_position(_joined(t, "rrp")), scale="fraction")
    return rounded(explore.bucket_summary(df), avg_price=4, avg_competitor_price=4, avg_revenue=4)


@query("price_position_buckets", BUCKETS_SQL + " SELECT * FROM summary", ("enriched",))
def price_position_buckets(t):
    return _buckets(t)


@query("best_worst_bucket", BUCKETS_SQL + """
SELECT arg_min(bucket, (-order_rate, bucket)) AS best, max(order_rate) AS best_score,
  arg_min(bucket, (order_rate, bucket)) AS worst, min(order_rate) AS worst_score
FROM summary WHERE order_rate IS NOT NULL""", ("enriched",))
def best_worst_bucket(t):
    return explore.best_worst(_buckets(t), "bucket", "order_rate")


# ---- daily series ----

DAILY = """daily AS (SELECT day, count(*) AS interactions, sum("order")::BIGINT AS orders,
  100.0 * sum("order") / count(*) AS order_rate FROM clean GROUP BY day)"""


@query("daily_series", f"""
SELECT day, count(*) AS interactions, sum("order")::BIGINT AS orders,
  {q('100.0 * sum("order") / count(*)')} AS order_rate, {q('avg(click)')} AS click_rate,
  {q('avg(basket)')} AS basket_rate, {q('avg(price)', 4)} AS avg_price,
  {q('avg("competitorPrice")', 4)} AS avg_comp FROM clean GROUP BY 1""", ("clean",))
def daily_series(t):
    return rounded(explore.daily_series(_clean(t)), avg_price=4, avg_comp=4)


@query("daily_extremes", f"""
WITH {DAILY}, ends AS (SELECT min(day) AS lo, max(day) AS hi FROM daily)
SELECT arg_min(day, (-interactions, day)) AS max_volume_day,
  arg_min(day, (interactions, day)) AS min_volume_day,
  arg_min(day, (-round(order_rate, 9), day)) AS max_rate_day,
  arg_min(day, (round(order_rate, 9), day)) AS min_rate_day,
  {q('avg(interactions) FILTER (day < lo + 10)')} AS first_days_avg,
  {q('avg(interactions) FILTER (day > hi - 10)')} AS last_days_avg FROM daily, ends""",
       ("clean",))
def daily_extremes(t):
    daily = rounded(explore.daily_series(_clean(t)), order_rate=9)
    return rounded(explore.daily_extremes(daily))


@query("structural_break", f"""
WITH {DAILY}, moved AS (SELECT day, round_even((order_rate - lag(order_rate) OVER (ORDER BY day))
  * 1e9, 0) / 1e9 AS change FROM daily)
SELECT arg_min(day, (change, day)) AS break_day, {q('min(change)')} AS rate_change
FROM moved WHERE change IS NOT NULL""", ("clean",))
def structural_break(t):
    return rounded(explore.detect_break(explore.daily_series(_clean(t))))


@query("regime_compare", f"""
WITH {DAILY}, m AS (SELECT avg(interactions) FILTER (day < 26) AS v0,
  avg(interactions) FILTER (day >= 26) AS v1, avg(order_rate) FILTER (day < 26) AS r0,
  avg(order_rate) FILTER (day >= 26) AS r1 FROM daily)
SELECT {q('v0')} AS volume_before, {q('v1')} AS volume_after, {q('r0')} AS rate_before,
  {q('r1')} AS rate_after, {q('(v1 / v0 - 1) * 100')} AS volume_change_pct,
  {q('r1 - r0')} AS rate_change_pp FROM m""", ("clean",))
def regime_compare(t):
    return rounded(explore.regime_compare(explore.daily_series(_clean(t)), schema.SHIFT_DAY))


@query("daily_price_trend", f"""
SELECT day, {q('avg(price)', 4)} AS avg_price, {q('avg("competitorPrice")', 4)} AS avg_comp,
  {q('avg(rrp)', 4)} AS avg_rrp, {q('avg(price - rrp)', 4)} AS avg_above_rrp_abs,
  {q('avg(price / rrp - 1)')} AS avg_above_rrp_pct, count("lineID") AS n
FROM enriched GROUP BY 1""", ("enriched",))
def daily_price_trend(t):
    return rounded(explore.daily_price_trend(_joined(t, "rrp")), avg_price=4, avg_comp=4,
                   avg_rrp=4, avg_above_rrp_abs=4)


@query("daily_price_gap", f"""
SELECT day, {q('avg(price)', 4)} AS avg_price, {q('avg("competitorPrice")', 4)} AS avg_comp,
  count("lineID") AS n, {q('avg(("competitorPrice" IS NULL)::INT) * 100')} AS comp_missing_rate,
  {q('avg(price) - avg("competitorPrice")', 4)} AS avg_gap,
  {q('avg(price) / avg("competitorPrice")')} AS avg_ratio FROM clean GROUP BY 1""", ("clean",))
def daily_price_gap(t):
    return rounded(explore.daily_gap(_clean(t)), avg_price=4, avg_comp=4, avg_gap=4)


def by_category_sql(key: str, source: str) -> str:
    return f"""
SELECT {key}, day, {q('avg(click)')} AS click_rate, {q('avg(basket)')} AS basket_rate,
  {q('avg("order")')} AS order_rate, {q('avg(price)', 4)} AS avg_price,
  {q('avg("competitorPrice")', 4)} AS avg_comp, count("lineID") AS n
FROM {source} GROUP BY 1, 2"""


@query("daily_by_price_category", """
WITH binned AS (SELECT *, CASE WHEN price < 1 THEN 1 WHEN price < 6 THEN 2 WHEN price < 9.85
  THEN 3 WHEN price < 16.45 THEN 4 WHEN price < 32.125 THEN 5 ELSE 6 END AS price_cat
  FROM clean)""" + by_category_sql("price_cat", "binned"), ("clean",))
def daily_by_price_category(t):
    return rounded(explore.daily_by_category(_clean(t)), avg_price=4, avg_comp=4)


@query("daily_by_group", by_category_sql('"group"', "enriched"), ("enriched",))
def daily_by_group(t):
    return rounded(explore.daily_by_category(_joined(t, "group"), "group"), avg_price=4,
                   avg_comp=4)


@query("daily_action_pivot", """
SELECT day, sum(click)::BIGINT AS click, sum(basket)::BIGINT AS basket,
  sum("order")::BIGINT AS "order" FROM interactions GROUP BY 1""", ("interactions",))
def daily_action_pivot(t):
    return explore.daily_action_pivot(cleaning.valid_actions(t.interactions))


@query("orders_by_weekday", """
SELECT w::INTEGER AS weekday, count(day) AS orders FROM range(1, 8) r(w) LEFT JOIN (
  SELECT day FROM interactions WHERE "order" = 1) ON (day - 1) % 7 + 1 = w GROUP BY 1""",
       ("interactions",))
def orders_by_weekday(t):
    return explore.seasonal_counts(t.interactions, ["weekday"])


@query("orders_by_week_weekday", """
SELECT ((day - 1) // 7 + 1)::INTEGER AS week_idx, ((day - 1) % 7 + 1)::INTEGER AS weekday,
  count(*) AS orders FROM interactions WHERE "order" = 1 GROUP BY 1, 2""", ("interactions",))
def orders_by_week_weekday(t):
    return explore.seasonal_counts(t.interactions, ["week_idx", "weekday"])


@query("order_autocorrelation", f"""
WITH d AS (SELECT day, sum("order") AS o FROM interactions GROUP BY 1),
a AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM d),
s AS (SELECT a.day, coalesce(o, 0)::DOUBLE AS o FROM a LEFT JOIN d USING (day))
SELECT l::INTEGER AS lag, {q('corr(x.o, y.o)')} AS autocorrelation
FROM range(1, 22) r(l) JOIN s x ON true JOIN s y ON x.day = y.day - l GROUP BY 1""",
       ("interactions",))
def order_autocorrelation(t):
    return rounded(explore.autocorrelation(t.interactions))


# ---- price bins, curves, conflicts ----

@query("content_formats", rf"""
WITH f AS (SELECT content, CASE WHEN regexp_full_match(content, '\d+(\.\d+)?') THEN 'numeric'
  WHEN regexp_full_match(content, '\d+(\.\d+)?([Xx]\d+(\.\d+)?)+') THEN 'multiplier'
  ELSE 'unknown' END AS content_format FROM items)
SELECT content_format, count(*) AS n,
  {q('100.0 * count(*) / (SELECT count(*) FROM f)')} AS pct,
  array_to_string(list_sort(list_distinct(list(content)))[1:3], ', ') AS examples
FROM f GROUP BY 1""", ("items",))
def content_formats(t):
    return rounded(explore.content_formats(t.items))


@query("log_ratio_by_action", f"""
WITH r AS (SELECT CASE WHEN click = 1 THEN 'click' WHEN basket = 1 THEN 'basket' ELSE 'order' END
  AS action, ln(price / "competitorPrice") AS v FROM clean WHERE "competitorPrice" IS NOT NULL)
SELECT action, count(*) AS n, {q('avg(v)')} AS mean_log_ratio,
  {q('100.0 * avg((v < 0)::INT)')} AS cheaper_pct, {q('quantile_cont(v, 0.5)')} AS median_log_ratio
FROM r WHERE v > -1 AND v < 1 GROUP BY 1""", ("clean",))
def log_ratio_by_action(t):
    return rounded(explore.log_ratio_by_action(t.interactions))


def quantile_bins_sql(column: str, source: str, n: int = 10) -> str:
    probs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""edges AS (SELECT list_sort(list_distinct(quantile_cont({column}, [{probs}]))) AS e
  FROM {source}),
binned AS (SELECT s.*, (1 + len(list_filter(e[2:len(e) - 1], lambda v: v < {column})))::INTEGER
  AS b FROM {source} s, edges)"""


DECILES = f"""
WITH {quantile_bins_sql('price', 'interactions')},
curve AS (SELECT b AS price_decile, count(*) AS n, avg(price) AS p, avg("order") AS r
  FROM binned GROUP BY 1)"""


@query("price_deciles", DECILES + f"""
SELECT price_decile, n, {q('p', 4)} AS mean_price, {q('r * 100')} AS order_rate_pct,
  {q('sqrt(r * (1 - r) / n)')} AS standard_error,
  {q('(r + 1.96 * sqrt(r * (1 - r) / n)) * 100')} AS ci_upper,
  {q('(r - 1.96 * sqrt(r * (1 - r) / n)) * 100')} AS ci_lower FROM curve""", ("interactions",))
def price_deciles(t):
    return rounded(explore.decile_curve(t.interactions), mean_price=4)


@query("conversion_drop", DECILES + f"""
SELECT {q('arg_min(r * 100, price_decile)')} AS first_rate_pct,
  {q('arg_max(r * 100, price_decile)')} AS last_rate_pct,
  {q('(arg_min(r, price_decile) - arg_max(r, price_decile)) / arg_min(r, price_decile) * 100')}
    AS conversion_drop_pct FROM curve""", ("interactions",))
def conversion_drop(t):
    return rounded(explore.conversion_drop(explore.decile_curve(t.interactions)))


@query("rates_by_price_bin", f"""
WITH {quantile_bins_sql('price', 'interactions')}
SELECT b AS price_bin, count(*) AS n, {q('avg(click)')} AS click_rate,
  {q('avg(basket)')} AS basket_rate, {q('avg("order")')} AS order_rate FROM binned GROUP BY 1""",
       ("interactions",))
def rates_by_price_bin(t):
    return rounded(explore.rates_by_bin(t.interactions))


@query("price_bins_equal", f"""
WITH r AS (SELECT min(price) AS lo, max(price) AS hi FROM interactions)
SELECT greatest(1, least(50, ceil((price - lo) / ((hi - lo) / 50))))::INTEGER AS bin,
  count(*) AS n, {q('min(price)')} AS min, {q('max(price)')} AS max
FROM interactions, r GROUP BY 1""", ("interactions",))
def price_bins_equal(t):
    return rounded(explore.equal_width_counts(t.interactions, "price", 50))


@query("price_histogram", f"""
WITH v AS (SELECT 'price' AS "column", price AS x FROM clean UNION ALL
  SELECT 'competitorPrice', "competitorPrice" FROM clean WHERE "competitorPrice" IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT "column", greatest(1, least(40, floor((x - lo) / ((hi - lo) / 40)) + 1))::INTEGER
  AS bin, lo, hi FROM v, r)
SELECT "column", bin, count(*) AS n, {q('ln(count(*))')} AS log_n,
  {q('any_value(lo + (bin - 1) * ((hi - lo) / 40))')} AS left_edge FROM b GROUP BY 1, 2""",
       ("clean",))
def price_histogram(t):
    return rounded(explore.histogram(_clean(t), ["price", "competitorPrice"], 40))


@query("impute_competitor_by_bin", f"""
WITH r AS (SELECT min(price) AS lo, max(price) AS hi FROM clean),
b AS (SELECT c.*, greatest(1, least(50, ceil((price - lo) / ((hi - lo) / 50))))::INTEGER
  AS price_bin FROM clean c, r),
s AS (SELECT price_bin, (avg("competitorPrice") - avg(price)) / avg(price) * 100 AS pct
  FROM b WHERE "competitorPrice" IS NOT NULL GROUP BY 1),
m AS (SELECT quantile_cont(("competitorPrice" - price) / price * 100, 0.5) AS f FROM clean),
f AS (SELECT b.*, coalesce(pct, f) AS pct_diff FROM b LEFT JOIN s USING (price_bin), m
  WHERE "competitorPrice" IS NULL)
SELECT "lineID", pid, day, {q('price')} AS price, price_bin, {q('pct_diff')} AS pct_diff,
  {q('price + price / 100 * pct_diff')} AS estimated_competitor_price FROM f""", ("clean",))
def impute_competitor_by_bin(t):
    return rounded(explore.impute_competitor_by_bin(_clean(t)))


CONFLICTS = """pairs AS (SELECT pid, day, count(DISTINCT price) AS u, min(price) AS lo,
  max(price) AS hi, count(*) AS n FROM interactions GROUP BY 1, 2)"""


@query("price_conflicts", f"""
WITH {CONFLICTS} SELECT pid, day, u AS n_unique_prices, {q('lo')} AS min_price,
  {q('hi')} AS max_price, n AS n_rows, {q('hi - lo')} AS price_diff FROM pairs WHERE u > 1""",
       ("interactions",))
def price_conflicts(t):
    return rounded(explore.price_conflicts(t.interactions))


@query("price_conflict_summary", f"""
WITH {CONFLICTS} SELECT count(*) AS pairs, count(*) FILTER (u > 1) AS conflicts,
  {q('100.0 * count(*) FILTER (u > 1) / count(*)')} AS conflict_pct,
  count(DISTINCT pid) FILTER (u > 1) AS pids_affected FROM pairs""", ("interactions",))
def price_conflict_summary(t):
    return rounded(explore.price_conflict_summary(t.interactions))


@query("worst_conflict_rows", f"""
WITH {CONFLICTS}, w AS (SELECT pid, day FROM pairs WHERE u > 1 ORDER BY hi - lo DESC, pid, day
  LIMIT 1)
SELECT "lineID", pid, day, {q('price')} AS price, {q('"competitorPrice"')} AS "competitorPrice",
  "adFlag", click, basket, "order" FROM interactions JOIN w USING (pid, day)""",
       ("interactions",))
def worst_conflict_rows(t):
    rows = explore.worst_conflict_rows(t.interactions)
    return rounded(rows.select("lineID", "pid", "day", "price", "competitorPrice", "adFlag",
                               "click", "basket", "order"))
