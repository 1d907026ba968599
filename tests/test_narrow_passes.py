"""Values, levels and neighbours come from passes over narrow, written rows."""

from pyspark.sql import functions as F

from marketgauge.catalog import QUERIES
from marketgauge.operators import explore, joins, neighbour_information


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_told_apart_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, 0.0, "a", None), (2, -0.0, "a", None), (3, float("nan"), None, None),
         (3, float("nan"), "b", None), (None, None, "", None)],
        "i long, x double, s string, none string")
    got = explore.distinct_profile(df)
    # As their text: the two zeros are two values.
    assert {r["column"]: r.n_distinct for r in got.collect()} == {
        "i": 3, "x": 3, "s": 3, "none": 0}
    # One reduction a column, of the values themselves.
    assert "Generate" not in _plan(got) and "cast(i" not in _plan(got)
    assert explore.distinct_profile(df.limit(0)).count() == 0


def test_index_tells_its_column_without_the_levels(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS l_orderkey, id % 3 AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber,
        2.0D AS l_quantity, 6.0D AS l_extendedprice, 0.0D AS l_discount, 0.0D AS l_tax,
        'R' AS l_returnflag, 'O' AS l_linestatus, timestamp'1995-02-01' AS l_shipdate
        FROM range(6)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("""SELECT id AS p_partkey, 'abcde' AS p_name, concat('m', id) AS p_brand, 't' AS p_type,
        cast(id AS int) AS p_size, 1.0D AS p_retailprice
        FROM range(2)""").write.parquet(f"{tmp_path}/part.parquet")
    joined = []
    lookup = joins.lookup

    def noted(df, table, keys, **options):
        joined.append((list(keys), table.count()))
        return lookup(df, table, keys, **options)

    monkeypatch.setattr(joins, "lookup", noted)
    got = QUERIES["onehot_sparse"](spark, str(tmp_path))
    cells = {(r["column"], r["index"]): r["count"]
             for r in got.groupBy("column", "index").count().collect()}
    # Product 2 has no item: its rows have a pid alone.
    assert cells == {("unit", 0): 2, ("unit", 1): 2, ("manufacturer", 2): 2,
                     ("manufacturer", 3): 2, ("pid", 4): 2, ("pid", 5): 2, ("pid", 6): 2}
    # The rows of all levels meet one row a column, not all levels.
    assert joined[-1][1] == 3


def test_rows_are_reduced_once(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 2).alias("y"),
                                 (F.col("id") * 37 % 101).cast("double").alias("x"))
    written = []
    cut = neighbour_information.cut

    def noted(frame):
        written.append(frame.columns)
        return cut(frame)

    monkeypatch.setattr(neighbour_information, "cut", noted)
    got = neighbour_information.neighbour_information(df, "y", ["x"])
    assert written[0] == ["column", "y", "x", "n"] and len(written) == 2
    # What follows reads the written numbers and sees no row again.
    assert "Range (" not in _plan(got)
