"""The order tables of a data folder seen as `interactions` and `items`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy views over one data folder; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def interactions(self) -> DataFrame:
        line = self.table("lineitem")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        competitor = (F.when(F.col("l_tax") < 0.005, F.lit(None).cast("double"))
                      .when(F.col("l_tax") > 0.075, F.lit(0.0))
                      .otherwise(price * (F.lit(0.85) + F.lit(4) * F.col("l_discount"))))

        def flag(returnflag: str):
            return (F.col("l_returnflag") == returnflag).cast("int")

        return line.select(
            F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey")
            .alias("lineID"),
            F.expr("datediff(l_shipdate, date'1995-01-01') div 28 + 1").cast("int").alias("day"),
            F.col("l_partkey").alias("pid"),
            (F.col("l_linestatus") == "O").cast("int").alias("adFlag"),
            ((F.col("l_linenumber") - 1) % 4 + 1).alias("availability"),
            competitor.alias("competitorPrice"),
            flag("N").alias("click"),
            flag("A").alias("basket"),
            flag("R").alias("order"),
            price.alias("price"),
            F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(F.lit(0.0))
            .alias("revenue"),
        )

    @property
    def items(self) -> DataFrame:
        part = self.table("part")
        key, size = F.col("p_partkey"), F.col("p_size")
        content = (F.when(key % 500 == 7, "PAK")
                   .when(key % 500 == 8, "L   125")
                   .when(key % 10 == 0, F.concat(F.lit("5X"), size.cast("string")))
                   .when(key % 10 == 1, "30X0.6")
                   .when(key % 10 == 2, "0.5")
                   .otherwise(size.cast("string")))
        unit = F.element_at(F.array(*map(F.lit, ["ST", "ML", "G", "CM"])), size % 4 + 1)
        index = F.element_at(F.array(*map(F.lit, [40, 44, 52, 53])), size % 4 + 1)
        return part.select(
            key.alias("pid"),
            F.col("p_brand").alias("manufacturer"),
            F.col("p_type").alias("group"),
            content.alias("content"),
            unit.alias("unit"),
            F.when(size % 9 != 0, F.concat(F.lit(" "), F.lower(F.substring("p_name", 1, 3))))
            .alias("pharmForm"),
            (key % 29 == 0).cast("int").alias("genericProduct"),
            index.alias("salesIndex"),
            F.when(size % 7 != 0, size).alias("category"),
            F.when(key % 16 == 0, "A").when(key % 16 == 1, "B").when(key % 16 == 2, "C")
            .alias("campaignIndex"),
            (F.col("p_retailprice") * 3).alias("rrp"),
        )


INTERACTIONS_SQL = """interactions AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS "lineID",
         (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 28 + 1)::INTEGER AS day,
         l_partkey AS pid,
         (l_linestatus = 'O')::INTEGER AS "adFlag",
         ((l_linenumber - 1) % 4 + 1)::INTEGER AS availability,
         CASE WHEN l_tax < 0.005 THEN NULL WHEN l_tax > 0.075 THEN 0.0::DOUBLE
              ELSE (l_extendedprice / l_quantity) * (0.85::DOUBLE + 4 * l_discount) END
           AS "competitorPrice",
         (l_returnflag = 'N')::INTEGER AS click,
         (l_returnflag = 'A')::INTEGER AS basket,
         (l_returnflag = 'R')::INTEGER AS "order",
         l_extendedprice / l_quantity AS price,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0::DOUBLE END AS revenue
  FROM lineitem)"""

ITEMS_SQL = """items AS (
  SELECT p_partkey AS pid, p_brand AS manufacturer, p_type AS "group",
         CASE WHEN p_partkey % 500 = 7 THEN 'PAK' WHEN p_partkey % 500 = 8 THEN 'L   125'
              WHEN p_partkey % 10 = 0 THEN '5X' || p_size::VARCHAR
              WHEN p_partkey % 10 = 1 THEN '30X0.6' WHEN p_partkey % 10 = 2 THEN '0.5'
              ELSE p_size::VARCHAR END AS content,
         ['ST', 'ML', 'G', 'CM'][(p_size % 4 + 1)::INTEGER] AS unit,
         CASE WHEN p_size % 9 <> 0 THEN ' ' || lower(substring(p_name, 1, 3)) END AS "pharmForm",
         (p_partkey % 29 = 0)::INTEGER AS "genericProduct",
         [40, 44, 52, 53][(p_size % 4 + 1)::INTEGER]::INTEGER AS "salesIndex",
         CASE WHEN p_size % 7 <> 0 THEN p_size END AS category,
         CASE p_partkey % 16 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END
           AS "campaignIndex",
         p_retailprice * 3 AS rrp
  FROM part)"""
