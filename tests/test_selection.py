"""Radix selection, narrow permutations, sparse levels and hashed neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgauge.operators import encoders, knn, models, sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).select(
        F.col("id").alias("lineID"), (F.col("id") % 7 + 0.5).alias("price"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("kind"),
        F.col("id").cast("string").alias("text")).cache()


def by_hand(rows, cuts):
    """Rows before each cut of their stratum, in hash order."""
    keyed = rows.withColumn("k", sampling.order_key(sampling.ROW_KEY, 5)).collect()
    out = {}
    for kind in {r.kind for r in keyed}:
        own = sorted((r for r in keyed if r.kind == kind), key=lambda r: tuple(r.k))
        for place, r in enumerate(own, 1):
            out[r.lineID] = sum(place > c for c in cuts[kind])
    return out


@pytest.mark.parametrize("bits,most", [(12, 100_000), (3, 40), (2, 1), (1, 5)])
def test_selection_descends_to_small_buckets(spark, rows, bits, most, monkeypatch):
    cuts = {None: [1, 200], 0: [0, 600, 1199], 1: [17], 2: [0]}
    table = spark.createDataFrame([(k, c) for k, v in cuts.items() for c in v],
                                  "kind long, cut_rank long")
    real = sampling.rank_thresholds
    monkeypatch.setattr(sampling, "rank_thresholds",
                        lambda *a: real(*a[:-1], bits=bits, most=most))
    out = sampling.label_by_rank(rows, ["kind"], table, sampling.ROW_KEY, 5, "side")
    want = by_hand(rows, cuts)
    assert {r.lineID: r.side for r in out.collect()} == want


def test_equal_keys_end_the_descent(spark):
    df = spark.range(50).select(F.lit(1).alias("lineID"), F.lit(2.0).alias("price"),
                                F.lit("a").alias("kind"))
    cuts = spark.createDataFrame([("a", 20)], "kind string, cut_rank long")
    found = sampling.rank_thresholds(df, ["kind"], cuts, sampling.ROW_KEY, 1, bits=16, most=10)
    assert len(found.first().thresholds) == 1


def test_ranks_are_places_in_hash_order(rows):
    for bits in (None, 2):
        out = sampling.hash_ranks(rows.select("lineID", "price"), sampling.ROW_KEY, 9, bits)
        keyed = out.withColumn("k", sampling.order_key(sampling.ROW_KEY, 9)).collect()
        assert [r["rank"] for r in sorted(keyed, key=lambda r: tuple(r.k))] == list(range(1, 4001))


def test_permutation_moves_only_what_is_tested(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_BUCKET", 1000)
    wide = rows.withColumn("weight", F.col("lineID") * 2)
    out = models.permuted_rows(wide, ["price", "weight"], 3)
    got = out.collect()
    assert sorted(r.lineID for r in got) == list(range(4000)) and out.columns == [
        *wide.columns, "_others"]
    for repeat in range(3):
        assert sorted(r._others[repeat].weight for r in got) == list(range(0, 8000, 2))
        assert sum(r._others[repeat].weight == r.weight for r in got) < 40
        assert all((r._others[repeat].weight // 2) % 7 + 0.5 == r._others[repeat].price for r in got)
    # Without broadcasts, no exchange carries the columns that are not tested.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = models.permuted_rows(wide, ["price", "weight"], 2)._jdf.queryExecution()
        text = plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in text.splitlines() if "FileScan" in line and "text#" in line]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]
    lines = text.splitlines()
    at = lines.index(scans[0])
    depth = lines[at].index("FileScan")
    above = []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            above.append(line)
            depth = indent
    assert any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in above)
    assert not any("Exchange" in x for x in above)


def test_many_levels(spark):
    df = spark.range(12_000).select(
        F.col("id").alias("lineID"), F.lit(1.0).alias("price"),
        F.concat(F.lit("v"), F.format_string("%05d", F.col("id") % 5000)).alias("many"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.col("id") % 4)).alias("few"),
        (F.col("id") % 2).cast("double").alias("label"))
    table = encoders.level_table(df, ["few", "many"])
    assert table.count() == 5003
    out = encoders.sparse_one_hot(df, ["few", "many"], table)
    for r in out.filter("lineID % 997 = 0").collect():
        k, n = r.lineID % 4, r.lineID % 5000
        assert r.levels == ([k - 1] if k else []) + [3 + n]
    first = encoders.level_table(df, ["few", "many"], drop_first=True)
    assert first.count() == 5001
    new = spark.createDataFrame([(1, "k2", "v00001"), (2, "unseen", "v00000"), (3, None, None)],
                                "lineID long, few string, many string")
    got = {r.lineID: r.levels for r in encoders.sparse_one_hot(new, ["few", "many"], first).collect()}
    assert got == {1: [0, 2], 2: [], 3: []}
    # The preparation of a model takes them as a sparse vector.
    prep = models.Preprocessor(numeric=["lineID"], one_hot=["few", "many"], min_frequency=2).fit(df)
    assert len(prep.names) == 1 + 4 + 5001 and prep.names[5] == "many=v00000"
    vector = prep.transform(df.filter("lineID = 4999")).first().features
    names = {prep.names[i] for i in vector.indices}
    assert vector.size == 5006 and names == {"lineID", "few=k3", "many=v04999"}
    unseen = df.limit(1).withColumn("many", F.lit("new"))
    vector = prep.transform(unseen).first().features
    assert "many=__infrequent__" in {prep.names[i] for i in vector.indices}


def test_hashed_neighbours_are_found(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16)) * 3
    points = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, str(i % 3), [float(x) for x in p])
                                for i, p in enumerate(points)], "id long, label string, vec array<double>")
    train, asked = df.filter("id % 10 <> 0"), df.filter("id % 10 = 0")
    exact = knn.nearest_neighbours(train, asked, 7).cache()
    found = knn.hashed_neighbours(train, asked, 7, bucket=150).cache()
    r = knn.recall_of(found, exact).first()
    assert (r.queries, r.neighbours) == (300, 2100) and 0.9 <= r.recall <= 1
    # What is met has its exact distance, and a row is met once.
    assert found.count() == found.dropDuplicates(["id", "train_id"]).count() == 2100
    both = found.join(exact, ["id", "train_id"]).filter(F.abs(found.dist - exact.dist) > 1e-9)
    assert both.count() == 0
    small = knn.hashed_neighbours(train, asked, 7, bucket=150, train_chunk=20, query_block=7)
    assert sorted(small.select("id", "train_id").collect()) == sorted(
        found.select("id", "train_id").collect())
    assert knn.hashed_neighbours(train.limit(0), asked, 7).count() == 0
    assert knn.hashed_neighbours(train, asked.limit(0), 7).count() == 0
