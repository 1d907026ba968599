"""Registration of queries and the SQL their results are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..sources.driver_tables import INTERACTIONS_SQL, ITEMS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared building blocks of the checking SQL, in dependency order.
CTES = {
    "interactions": INTERACTIONS_SQL,
    "items": ITEMS_SQL,
    # Competitor price 0 or less is missing.
    "clean": """clean AS (
  SELECT * REPLACE (CASE WHEN "competitorPrice" > 0 THEN "competitorPrice" END
                    AS "competitorPrice") FROM interactions)""",
    "enriched": """enriched AS (
  SELECT c.*, i.* EXCLUDE (pid) FROM clean c LEFT JOIN items i USING (pid))""",
    "scored": """scored AS (
  SELECT "lineID", pid, day, price, "order" AS label, 1 / (1 + price / 1000) AS score
  FROM interactions)""",
}
NEEDS = {"clean": ["interactions"], "enriched": ["interactions", "items", "clean"],
         "scored": ["interactions"]}


def with_ctes(body: str, *names: str) -> str:
    wanted = set(names)
    for n in names:
        wanted.update(NEEDS.get(n, []))
    parts = [CTES[n] for n in CTES if n in wanted]
    # A body that starts with WITH continues the list.
    if parts and body.lstrip().upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body.lstrip()[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a function of `Tables` under `name`; `sql` may use the named CTEs."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Rounds every double column half-even so that both engines print the same value."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: round_half_even(c, columns.get(c, digits)) for c in doubles})


def q(expr: str, digits: int = 6) -> str:
    """The same rounding in the checking SQL."""
    scale = f"1e{digits}"
    return f"(round_even(({expr})::DOUBLE * {scale}, 0) / {scale})"


def col_round(c: str, digits: int = 6) -> Column:
    return round_half_even(F.col(c), digits)
