"""Queries for correlations, association and feature screening."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.features import competitor_gap, null_nonpositive, rrp_position
from ..operators import joins, stats
from ..operators.neighbour_information import neighbour_information
from .exploring import quantile_bins_sql
from .registry import q, query, rounded

NUMBERS = ["price", "competitorPrice", "rrp", "availability", "adFlag", "click", "order"]


def _joined(t, *columns):
    return joins.enrich(null_nonpositive(t.interactions), t.items, list(columns))


def pairs_sql(pairs, source: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, {q(f'corr("{a}", "{b}")')} AS r FROM {source}"""
        for a, b in pairs)


@query("price_correlation", f"""
WITH u AS ({pairs_sql(combinations(NUMBERS, 2), 'enriched')})
SELECT a, b, r FROM u UNION ALL SELECT b, a, r FROM u
UNION ALL SELECT unnest({NUMBERS!r}) AS a, unnest({NUMBERS!r}) AS b, 1.0::DOUBLE""",
       ("enriched",))
def price_correlation(t):
    return rounded(stats.corr_matrix(_joined(t, "rrp"), NUMBERS))


@query("corr_with_order", f"""
SELECT a AS "column", r FROM ({pairs_sql([(c, 'order') for c in NUMBERS[:-1]], 'enriched')})""",
       ("enriched",))
def corr_with_order(t):
    return rounded(stats.corr_with(_joined(t, "rrp"), "order", NUMBERS[:-1]))


GAPS = ["price", "competitorPrice", "price_ratio", "discount", "rrp"]


@query("high_corr_pairs", f"""
WITH g AS (SELECT *, price / "competitorPrice" AS price_ratio, (rrp - price) / rrp AS discount
  FROM enriched), u AS ({pairs_sql(combinations(GAPS, 2), 'g')})
SELECT a, b, r, abs(r) AS abs_r FROM u WHERE abs(r) > 0.8""", ("enriched",))
def high_corr_pairs(t):
    df = competitor_gap(rrp_position(_joined(t, "rrp")), scale="fraction").withColumnsRenamed(
        {"price_ratio_competitor": "price_ratio", "discount_to_rrp_pct": "discount"})
    return rounded(stats.high_corr_pairs(df, GAPS))


def cramers_sql(a: str, b: str) -> str:
    """Over the full grid of cells, with the continuity correction on 2 x 2 tables."""
    return f"""
SELECT '{a}' AS a, '{b}' AS b, {q('sum(x)', 5)} AS chi2, any_value(n)::BIGINT AS n,
  {q('sqrt(sum(x) / (any_value(n) * (least(any_value(k), any_value(m)) - 1)))')} AS cramers_v
FROM (SELECT CASE WHEN k = 2 AND m = 2 THEN (abs(o - e) - least(0.5, abs(o - e))) ** 2 / e
        ELSE (o - e) ** 2 / e END AS x, n, k, m
  FROM (SELECT coalesce(c.o, 0) AS o, r.o * s.o / t.n AS e, t.n, t.k, t.m
    FROM (SELECT "{a}" AS a, count(*)::DOUBLE AS o FROM enriched
          WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL GROUP BY 1) r
    CROSS JOIN (SELECT "{b}" AS b, count(*)::DOUBLE AS o FROM enriched
          WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL GROUP BY 1) s
    CROSS JOIN (SELECT count(*)::DOUBLE AS n, count(DISTINCT "{a}") AS k,
          count(DISTINCT "{b}") AS m FROM enriched
          WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) t
    LEFT JOIN (SELECT "{a}" AS a, "{b}" AS b, count(*)::DOUBLE AS o FROM enriched GROUP BY 1, 2) c
      ON c.a = r.a AND c.b = s.b))"""


ASSOCIATIONS = [("adFlag", "order"), ("availability", "order"), ("group", "unit"),
                ("category", "campaignIndex")]


@query("cramers_v", "\nUNION ALL\n".join(cramers_sql(a, b) for a, b in ASSOCIATIONS),
       ("enriched",))
def cramers_v(t):
    df = _joined(t, "group", "unit", "category", "campaignIndex")
    parts = [stats.cramers_v(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
             for a, b in ASSOCIATIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, chi2=5)


def mi_sql(name: str, value: str, source: str) -> str:
    return f"""
SELECT '{name}' AS "column", sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM (
  SELECT v, y, count(*)::DOUBLE AS nxy, sum(count(*)) OVER (PARTITION BY v)::DOUBLE AS nx,
    sum(count(*)) OVER (PARTITION BY y)::DOUBLE AS ny, sum(count(*)) OVER ()::DOUBLE AS n
  FROM (SELECT {value} AS v, "order" AS y FROM {source}) GROUP BY v, y)"""


@query("mutual_information", f"""
WITH {quantile_bins_sql('price', 'enriched')},
scores AS ({mi_sql('price', 'b', 'binned')} UNION ALL
  {mi_sql('category', 'category', 'enriched')} UNION ALL
  {mi_sql('manufacturer', 'manufacturer', 'enriched')} UNION ALL
  {mi_sql('adFlag', '"adFlag"', 'enriched')} UNION ALL
  {mi_sql('availability', 'availability', 'enriched')})
SELECT "column", {q('mi', 8)} AS mi FROM scores ORDER BY scores.mi DESC LIMIT 4""", ("enriched",))
def mutual_information(t):
    df = _joined(t, "category", "manufacturer")
    out = stats.mutual_information(df, "order", ["category", "manufacturer", "adFlag",
                                                 "availability"], ["price"], top=4)
    return rounded(out, 8)


def digamma_sql(x: str) -> str:
    z = f"({x} + 6.0::DOUBLE)"
    steps = " + ".join(f"1.0::DOUBLE / ({x} + {j})" for j in range(6))
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * pow({z}, 4))"
            f" - 1 / (252 * pow({z}, 6)) - ({steps}))")


INFORMED = ["price", "competitorPrice", "rrp", "day"]
GAIN = (f"greatest(0, {digamma_sql('count(*)')} + avg({digamma_sql('k')} "
        f"- {digamma_sql('rows')} - {digamma_sql('m')}))")
PLACES = "(PARTITION BY \"column\", y ORDER BY x, id)"


@query("mutual_information_neighbours", f"""
WITH long AS ({" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", "order" AS y, "lineID" AS id,
    floor("{c}"::DOUBLE / 1e-6::DOUBLE + 0.5::DOUBLE)::BIGINT AS x
    FROM enriched WHERE "{c}" IS NOT NULL""" for c in INFORMED)}),
kept AS (SELECT *, count(*) OVER (PARTITION BY "column", y) AS rows FROM long
  QUALIFY rows > 1),
near AS (
  SELECT *, least(3, rows - 1) AS k, list_sort(list_filter([{", ".join(
    f"abs(x - {f}(x, {j}) OVER {PLACES})" for f in ("lag", "lead") for j in (1, 2, 3))}],
    lambda d: d IS NOT NULL)) AS far FROM kept),
radius AS (SELECT *, greatest(far[k] - 1, 0) AS inside FROM near),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY "column" ORDER BY x
    RANGE BETWEEN inside PRECEDING AND inside FOLLOWING) AS m FROM radius)
SELECT "column", {q(GAIN, 8)} AS mi FROM counted GROUP BY "column"
""", ("enriched",))
def mutual_information_neighbours(t):
    df = _joined(t, "rrp")
    return rounded(neighbour_information(df, "order", INFORMED), 8)


@query("zero_variance", """
SELECT 'single' AS "column" FROM interactions HAVING count(DISTINCT click + basket + "order") = 1
""", ("interactions",))
def zero_variance(t):
    df = t.interactions.withColumn("single", F.col("click") + F.col("basket") + F.col("order"))
    return stats.zero_variance(df, ["single", "price", "availability", "order"])


def newton_sql(steps: int) -> str:
    """CTEs f0, f1, ..: intercept a and slope b of a logit of y on x in d, by Newton's method, with
    the second derivatives they were made from."""
    out = ["f0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS h11, "
           "1.0::DOUBLE AS det)"]
    for i in range(steps):
        out.append(f"""f{i + 1} AS (
  SELECT a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a,
    b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b, h11, h11 * h22 - h12 * h12 AS det
  FROM (
    SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS g1, sum((y - p) * x) AS g2,
      sum(p * (1 - p)) AS h11, sum(p * (1 - p) * x) AS h12, sum(p * (1 - p) * x * x) AS h22
    FROM (SELECT a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM d, f{i})))""")
    return ",\n".join(out)


NEWTON, SIMPSON = 9, 2000


@query("price_elasticity", f"""
WITH d AS (SELECT ln(price) AS x, "order"::DOUBLE AS y, price FROM interactions
  WHERE price > 0 AND "order" IS NOT NULL),
{newton_sql(NEWTON)},
z AS (SELECT b, abs(b) / sqrt(h11 / det) AS z FROM f{NEWTON}),
tail AS (
  SELECT any_value(b) AS b, 1 - 2 * any_value(z) / {3 * SIMPSON} / sqrt(2 * pi()) * sum(
    CASE WHEN i = 0 OR i = {SIMPSON} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-pow(z * i / {SIMPSON}, 2) / 2)) AS p
  FROM z, range({SIMPSON + 1}) AS r(i))
SELECT {q('any_value(b)')} AS coefficient, {q('any_value(p)')} AS p_value,
  {q('any_value(b) * avg(price) * (1 - avg(y))')} AS elasticity FROM d, tail""", ("interactions",))
def price_elasticity(t):
    return rounded(stats.price_elasticity(t.interactions))
