"""Two lookups in one exchange of the wide rows."""

import pytest

from marketgauge.operators import joins


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("composite")
    facts = [(i, None if i % 50 == 0 else (1 if i % 3 else i % 40), None if i % 41 == 0 else i % 9,
              f"wide {i}") for i in range(3000)]
    spark.createDataFrame(facts, "id long, pid int, day int, revenue string").write.parquet(
        f"{folder}/facts")
    items = spark.createDataFrame([(p, f"m{p % 4}", p * 1.5) for p in range(30)],
                                  "pid int, maker string, rrp double")
    features = spark.createDataFrame(
        [(p, d, p * 10 + d) for p in range(0, 40, 2) for d in range(0, 9, 2)],
        "pid int, day int, diff int")
    return spark.read.parquet(f"{folder}/facts"), items, features


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [0, 200, 10 ** 6])
def test_same_rows_as_two_joins(tables, most):
    facts, items, features = tables
    got = joins.enrich_and_attach(facts, items, features, ["pid", "day"], max_bytes=most)
    want = facts.join(items, "pid", "left").join(features, ["pid", "day"], "left").select(
        got.columns)
    assert got.columns == ["id", "pid", "day", "revenue", "maker", "rrp", "diff"]
    assert plain(got) == plain(want)


def test_wide_rows_cross_one_exchange(spark, tables):
    facts, items, features = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = joins.enrich_and_attach(facts, items, features, ["pid", "day"], max_bytes=0)
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "FileScan" in line and "revenue#" in line]
    depth, exchanges = lines[at].index("FileScan"), 0
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            exchanges += "Exchange hashpartitioning" in line
    assert exchanges == 1


def test_an_item_is_written_once(tables, monkeypatch):
    facts, items, features = tables
    counted, written = joins.cut_counted, []

    def noted(df, *args):
        out = counted(df, *args)
        written.append(("maker" in df.columns, out[1]))
        return out

    monkeypatch.setattr(joins, "cut_counted", noted)
    joins.enrich_and_attach(facts, items, features, ["pid", "day"], max_bytes=0).count()
    # 30 items and the 5 products that have features alone.
    assert [n for wide, n in written if wide] == [35]
