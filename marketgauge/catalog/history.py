"""Queries for strictly-past history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import null_nonpositive
from ..operators import history, joins
from .features import PREV_SQL
from .registry import q, query, rounded


def _rows(t, *columns):
    """Facts with the listed item columns."""
    df = null_nonpositive(t.interactions)
    return joins.enrich(df, t.items, list(columns)) if columns else df


def _name(key: str) -> str:
    return f'"{key}"'


def expanding_sql(key: str) -> str:
    k = _name(key)
    return f"""
WITH daily AS (SELECT {k} AS k, day, count(*) AS n, sum("order") AS o, sum(price) AS p
  FROM enriched WHERE {k} IS NOT NULL GROUP BY 1, 2)
SELECT a.k AS {k}, a.day, {q('sum(b.o) / sum(b.n)')} AS "historical_conversion_{key}",
  {q('sum(b.p ORDER BY b.day) / sum(b.n)')} AS "historical_avg_price_{key}",
  coalesce(sum(b.n), 0)::BIGINT AS "n_prior_appearances_{key}"
FROM daily a LEFT JOIN daily b ON a.k = b.k AND b.day < a.day GROUP BY 1, 2"""


def _expanding(t, key: str):
    df = _rows(t) if key == "pid" else _rows(t, key)
    return rounded(history.expanding_history(df, key))


@query("expanding_history_pid", expanding_sql("pid"), ("enriched",))
def expanding_history_pid(t):
    return _expanding(t, "pid")


@query("expanding_history_manufacturer", expanding_sql("manufacturer"), ("enriched",))
def expanding_history_manufacturer(t):
    return _expanding(t, "manufacturer")


@query("expanding_history_group", expanding_sql("group"), ("enriched",))
def expanding_history_group(t):
    return _expanding(t, "group")


@query("price_diff_prev_day", f"""
WITH {PREV_SQL}
SELECT i."lineID", {q('diff')} AS price_diff_vs_previous_available_day
FROM interactions i LEFT JOIN prev USING (pid, day)""", ("interactions",))
def price_diff_prev_day(t):
    df = t.interactions.select("lineID", "pid", "day", "price")
    out = joins.attach(df, history.price_diff_prev_day(df), ["pid", "day"])
    return rounded(out.select("lineID", "price_diff_vs_previous_available_day"))


@query("price_vs_history", f"""
WITH daily AS (SELECT pid, day, count(*) AS n, sum(price) AS p FROM interactions GROUP BY 1, 2),
past AS (SELECT pid, day, sum(p) OVER w / sum(n) OVER w AS avg_price FROM daily
  WINDOW w AS (PARTITION BY pid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT i."lineID", {q('price / avg_price')} AS price_vs_hist_avg_pid
FROM interactions i LEFT JOIN past USING (pid, day)""", ("interactions",))
def price_vs_history(t):
    out = history.add_expanding_history(t.interactions, ["pid"])
    return rounded(out.select("lineID", "price_vs_hist_avg_pid"))


@query("pid_prev_day", f"""
WITH daily AS (SELECT pid, day, count(*) AS n, sum("order")::BIGINT AS o FROM interactions
  GROUP BY 1, 2)
SELECT pid, day, lag(o) OVER w AS pid_prev_day_orders, lag(n) OVER w AS pid_prev_day_interactions,
  {q('lag(o) OVER w / lag(n) OVER w')} AS pid_prev_day_order_rate
FROM daily WINDOW w AS (PARTITION BY pid ORDER BY day)""", ("interactions",))
def pid_prev_day(t):
    return rounded(history.prev_day(t.interactions, "pid"))


def rolling_sql(key: str, n: int) -> str:
    k = _name(key)
    return f"""
WITH daily AS (SELECT {k} AS k, day, count(*) AS n, sum("order") AS o FROM enriched
  WHERE {k} IS NOT NULL GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS r FROM daily)
SELECT a.k AS {k}, a.day, sum(b.o)::BIGINT AS {key}_prev_{n}d_orders,
  sum(b.n)::BIGINT AS {key}_prev_{n}d_interactions,
  {q('sum(b.o) / sum(b.n)')} AS {key}_prev_{n}d_order_rate,
  (sum(b.n) IS NOT NULL)::INTEGER AS has_{key}_history
FROM numbered a LEFT JOIN numbered b ON a.k = b.k AND b.r BETWEEN a.r - {n} AND a.r - 1
GROUP BY 1, 2"""


@query("pid_rolling_3d", rolling_sql("pid", 3), ("enriched",))
def pid_rolling_3d(t):
    return rounded(history.rolling_history(t.interactions, "pid", 3))


@query("pid_rolling_7d", rolling_sql("pid", 7), ("enriched",))
def pid_rolling_7d(t):
    return rounded(history.rolling_history(t.interactions, "pid", 7))


@query("category_rolling_7d", rolling_sql("category", 7), ("enriched",))
def category_rolling_7d(t):
    return rounded(history.rolling_history(_rows(t, "category"), "category", 7))


def price_change_sql(price: str) -> str:
    return f"""
WITH daily AS (SELECT pid, day, {price} AS p FROM interactions GROUP BY 1, 2),
moved AS (SELECT pid, day, p, lag(p) OVER (PARTITION BY pid ORDER BY day) AS b FROM daily)
SELECT pid, day, {q('b')} AS pid_prev_price, {q('(p - b) / b')} AS pid_price_change_pct
FROM moved"""


@query("pid_price_change", price_change_sql("avg(price)"), ("interactions",))
def pid_price_change(t):
    return rounded(history.price_change_pct(t.interactions))


@query("pid_first_price_change", price_change_sql('arg_min(price, ("lineID", price))'),
       ("interactions",))
def pid_first_price_change(t):
    return rounded(history.price_change_pct(t.interactions, first_price=True))


@query("expanding_cvr_category", f"""
WITH daily AS (SELECT category, day, sum("order") AS o, sum(click) AS c FROM enriched
  WHERE category IS NOT NULL GROUP BY 1, 2)
SELECT a.category, a.day, {q('sum(b.o) / nullif(sum(b.c), 0)')} AS expanding_cvr_category
FROM daily a LEFT JOIN daily b ON a.category = b.category AND b.day < a.day
GROUP BY 1, 2""", ("enriched",))
def expanding_cvr_category(t):
    return rounded(history.expanding_cvr(_rows(t, "category"), "category"))


@query("expanding_cvr_pid", f"""
WITH daily AS (SELECT pid, day, sum("order") AS o, sum(click) AS c FROM interactions GROUP BY 1, 2)
SELECT a.pid, a.day, {q('sum(b.o) / nullif(sum(b.c), 0)')} AS expanding_cvr_pid
FROM daily a LEFT JOIN daily b ON a.pid = b.pid AND b.day < a.day
GROUP BY 1, 2""", ("interactions",))
def expanding_cvr_pid(t):
    return rounded(history.expanding_cvr(t.interactions, "pid"))


@query("history_features", f"""
WITH pd AS (SELECT pid, day, count(*) AS n, sum("order") AS o, avg(price) AS p FROM enriched
  GROUP BY 1, 2),
ph AS (SELECT pid, day, lag(o) OVER w / lag(n) OVER w AS r1,
  sum(o) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
    / sum(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3,
  sum(o) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    / sum(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
  sum(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n7,
  (p - lag(p) OVER w) / lag(p) OVER w AS c
  FROM pd WINDOW w AS (PARTITION BY pid ORDER BY day)),
cd AS (SELECT category, day, count(*) AS n, sum("order") AS o FROM enriched
  WHERE category IS NOT NULL GROUP BY 1, 2),
ch AS (SELECT category, day, sum(o) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
    / sum(n) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r
  FROM cd WINDOW w AS (PARTITION BY category ORDER BY day))
SELECT e."lineID", {q('r1')} AS pid_prev_day_order_rate, {q('r3')} AS pid_prev_3d_order_rate,
  {q('r7')} AS pid_prev_7d_order_rate, n7::BIGINT AS pid_prev_7d_interactions,
  {q('c')} AS pid_price_change_pct, {q('r')} AS category_prev_7d_order_rate,
  (r1 IS NOT NULL)::INTEGER AS has_pid_history, (r IS NOT NULL)::INTEGER AS has_category_history
FROM enriched e LEFT JOIN ph USING (pid, day)
LEFT JOIN ch ON ch.category = e.category AND ch.day = e.day""", ("enriched",))
def history_features(t):
    df = _rows(t, "category").select("lineID", "pid", "day", "category", "price", "order", "click")
    out = history.add_history(df)
    return rounded(out.drop("pid", "day", "category", "price", "order", "click"))
