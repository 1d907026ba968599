"""Queries for samples, splits, folds and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore, joins, sampling
from .registry import q, query, rounded

SAMPLE = 5000


def quota_sql(sizes: str, keys: str, n: str) -> str:
    """Largest-remainder shares of n over the strata."""
    return f"""
sizes AS ({sizes}),
shares AS (SELECT *, rows * ({n})::DOUBLE / sum(rows) OVER () AS exact FROM sizes),
ranked AS (SELECT *, ({n}) - sum(floor(exact)) OVER () AS spare, row_number() OVER (
  ORDER BY round(exact - floor(exact), 9) DESC, {keys}) AS place FROM shares),
quotas AS (SELECT *, (floor(exact) + (place <= spare)::INT)::BIGINT AS quota FROM ranked)"""


# As counted below a sample must be no larger than the table.
N_SQL = f"(SELECT least({SAMPLE}, count(*)) FROM interactions)"


@query("stratified_sample_counts", f"""
WITH {quota_sql('''SELECT "order", (day // 7)::INTEGER AS week, count(*) AS rows
  FROM interactions GROUP BY 1, 2 HAVING count(*) >= 2''', '"order", week', N_SQL)}
SELECT "order", week, quota AS n FROM quotas WHERE quota > 0""", ("interactions",))
def stratified_sample_counts(t):
    sample = sampling.stratified_sample(t.interactions, SAMPLE)
    week = F.floor(F.col("day") / 7).cast("int")
    return sample.groupBy("order", week.alias("week")).agg(F.count("*").alias("n"))


@query("stratified_split_counts", f"""
WITH {quota_sql('SELECT "order", count(*) AS rows FROM interactions GROUP BY 1', '"order"',
                '(SELECT ceil(count(*) * 0.2) FROM interactions)')}
SELECT 'test' AS split, "order", quota AS n FROM quotas
UNION ALL SELECT 'train', "order", rows - quota FROM quotas""", ("interactions",))
def stratified_split_counts(t):
    split = sampling.stratified_split(t.interactions, "order", 0.2)
    return split.groupBy("split", "order").agg(F.count("*").alias("n"))


@query("stratified_split_null", f"""
WITH {quota_sql('SELECT category, count(*) AS rows FROM items GROUP BY 1',
                'category NULLS FIRST', '(SELECT ceil(count(*) * 0.2) FROM items)')}
SELECT 'test' AS split, category, quota AS n FROM quotas WHERE quota > 0
UNION ALL SELECT 'train', category, rows - quota FROM quotas WHERE rows > quota""", ("items",))
def stratified_split_null(t):
    split = sampling.stratified_split(t.items, "category", 0.2, keys=["pid"])
    return split.groupBy("split", "category").agg(F.count("*").alias("n"))


@query("oversample_null", """
WITH c AS (SELECT category, count(*) AS n FROM items GROUP BY 1)
SELECT category, (SELECT max(n) FROM c) AS n, n AS distinct_rows FROM c""", ("items",))
def oversample_null(t):
    out = sampling.oversample(t.items, "category", keys=["pid"])
    return out.groupBy("category").agg(F.count("*").alias("n"),
                                       F.count_distinct("pid").alias("distinct_rows"))


@query("kfold_null", """
SELECT category, f::INTEGER AS fold, (c // 5 + (f < c % 5)::INT)::BIGINT AS n
FROM (SELECT category, count(*) AS c FROM items GROUP BY 1), range(5) r(f)
WHERE c // 5 + (f < c % 5)::INT > 0""", ("items",))
def kfold_null(t):
    return (sampling.kfold(t.items, "category", 5, keys=["pid"]).groupBy("category", "fold")
            .agg(F.count("*").alias("n")))


@query("stratified_split_drift", f"""
WITH {quota_sql('SELECT "order", count(*) AS rows FROM interactions GROUP BY 1', '"order"',
                '(SELECT ceil(count(*) * 0.2) FROM interactions)')},
s AS (SELECT 'test' AS split, "order" AS v, quota AS n FROM quotas
  UNION ALL SELECT 'train', "order", rows - quota FROM quotas),
o AS (SELECT avg("order") AS m FROM interactions)
SELECT split, sum(n)::BIGINT AS n, {q('sum(v * n) / sum(n)')} AS rate,
  {q('abs(sum(v * n) / sum(n) - any_value(m))')} AS drift FROM s, o GROUP BY 1""",
       ("interactions",))
def stratified_split_drift(t):
    return rounded(sampling.split_drift(
        sampling.stratified_split(t.interactions, "order", 0.2), "order"))


@query("random_split", """
SELECT count(*) AS rows, count(*) AS distinct_rows, true AS near_share FROM interactions""",
       ("interactions",))
def random_split(t):
    """What holds for any hash: each row on one side, and a test share within 5 deviations."""
    split = sampling.random_split(t.interactions, 0.2)
    n, test = F.count("*"), F.count_if(F.col("split") == "test")
    return split.filter(F.col("split").isin("train", "test")).agg(
        n.alias("rows"), F.count_distinct("lineID", "price").alias("distinct_rows"),
        (F.abs(test - 0.2 * n) < 5 * F.sqrt(0.16 * n)).alias("near_share"))


@query("random_sample_counts", """
SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS distinct_rows FROM interactions""",
       ("interactions",))
def random_sample_counts(t):
    sample = sampling.random_sample(t.interactions, 1000)
    return sample.agg(F.count("*").alias("n"),
                      F.count_distinct("lineID", "price").alias("distinct_rows"))


@query("time_split_summary", f"""
SELECT 'two_way' AS kind, CASE WHEN day < 79 THEN 'train' ELSE 'test' END AS split,
  count(*) AS n, min(day) AS first_day, max(day) AS last_day, {q('avg("order")')} AS order_rate
FROM interactions GROUP BY 1, 2
UNION ALL SELECT 'three_way', CASE WHEN day < 69 THEN 'train' WHEN day < 79 THEN 'valid'
  ELSE 'test' END, count(*), min(day), max(day), {q('avg("order")')}
FROM interactions GROUP BY 1, 2""", ("interactions",))
def time_split_summary(t):
    def one(kind, cuts):
        return (sampling.time_split(t.interactions, cuts).groupBy("split")
                .agg(F.count("*").alias("n"), F.min("day").alias("first_day"),
                     F.max("day").alias("last_day"), F.avg("order").alias("order_rate"))
                .select(F.lit(kind).alias("kind"), "*"))
    return rounded(one("two_way", [79]).unionByName(one("three_way", [69, 79])))


@query("split_by_day_share", """
WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k
  FROM (SELECT DISTINCT day FROM interactions))
SELECT CASE WHEN i < floor(k * 0.7::DOUBLE) THEN 'train'
  WHEN i < floor(k * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split,
  count(DISTINCT day) AS days, count(*) AS n
FROM interactions JOIN d USING (day) GROUP BY 1""", ("interactions",))
def split_by_day_share(t):
    split = sampling.day_share_split(t.interactions, [0.70, 0.85])
    return split.groupBy("split").agg(F.count_distinct("day").alias("days"),
                                      F.count("*").alias("n"))


@query("day_membership", """
WITH busy AS (SELECT day FROM interactions GROUP BY 1 HAVING count(*) > (
  SELECT avg(n) FROM (SELECT count(*) AS n FROM interactions GROUP BY day)))
SELECT day, count(*) AS n FROM interactions WHERE day IN (SELECT day FROM busy) GROUP BY 1""",
       ("interactions",))
def day_membership(t):
    daily = t.interactions.groupBy("day").agg(F.count("*").alias("n"))
    busy = daily.filter(F.col("n") > daily.agg(F.avg("n").alias("m")).scalar()).select("day")
    kept = joins.membership(t.interactions, busy, ["day"])
    return kept.groupBy("day").agg(F.count("*").alias("n"))


@query("kfold_counts", """
SELECT "order", f::INTEGER AS fold, (c // 5 + (f < c % 5)::INT)::BIGINT AS n
FROM (SELECT "order", count(*) AS c FROM interactions GROUP BY 1), range(5) r(f)""",
       ("interactions",))
def kfold_counts(t):
    return (sampling.kfold(t.interactions, "order", 5).groupBy("order", "fold")
            .agg(F.count("*").alias("n")))


@query("oversample", """
WITH c AS (SELECT "order", count(*) AS n FROM interactions GROUP BY 1)
SELECT "order", (SELECT max(n) FROM c) AS n, n AS distinct_rows FROM c""", ("interactions",))
def oversample(t):
    out = sampling.oversample(t.interactions, "order")
    return out.groupBy("order").agg(F.count("*").alias("n"),
                                    F.count_distinct("lineID", "price").alias("distinct_rows"))


@query("split_shares", f"""
WITH s AS (SELECT "order", day < 79 AS train FROM interactions)
SELECT "order", {q('count(*) FILTER (train) / (SELECT count(*) FROM s WHERE train)')}
  AS train_share, {q('count(*) FILTER (NOT train) / (SELECT count(*) FROM s WHERE NOT train)')}
  AS test_share FROM s GROUP BY 1""", ("interactions",))
def split_shares(t):
    split = sampling.time_split(t.interactions, [79])
    return rounded(explore.share_compare(split.filter("split = 'train'"),
                                         split.filter("split = 'test'"), "order",
                                         ("train", "test")))
