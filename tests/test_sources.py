import pytest

from marketgauge import schema
from marketgauge.operators import cleaning
from marketgauge.sources import tables as io


def test_csv_round_trip(spark, interactions, items, tmp_path):
    io.write_csv(interactions, str(tmp_path / "train"))
    io.write_csv(items, str(tmp_path / "items"), single_file=True)
    back = io.read_interactions(spark, str(tmp_path / "train"))
    assert back.schema == schema.INTERACTIONS
    assert sorted(back.collect()) == sorted(interactions.collect())
    assert io.read_items(spark, str(tmp_path / "items")).count() == 3


def test_wrong_delimiter_raises(spark, interactions, tmp_path):
    io.write_csv(interactions, str(tmp_path / "x"), sep=";")
    with pytest.raises(KeyError):
        io.read_interactions(spark, str(tmp_path / "x"))


def test_column_order_follows_the_header(spark, items, tmp_path):
    io.write_csv(items.select(*reversed(items.columns)), str(tmp_path / "x"))
    back = io.read_items(spark, str(tmp_path / "x"))
    assert sorted(r.pid for r in back.collect()) == [10, 20, 30]


def test_required_columns(interactions):
    with pytest.raises(KeyError):
        io.require_columns(interactions, ["nope"])


def test_column_kinds(items):
    assert "rrp" in io.numeric_columns(items, exclude=["pid"])
    assert "pid" not in io.numeric_columns(items, exclude=["pid"])
    assert io.categorical_columns(items)[:2] == ["manufacturer", "group"]


def test_preview_is_seeded(interactions):
    first = io.preview(interactions, 4, ["lineID"], seed=1).collect()
    again = io.preview(interactions.repartition(7), 4, ["lineID"], seed=1).collect()
    assert len(first) == 4 and first == again


def test_schema_profile(items):
    rows = io.schema_profile(items).collect()
    assert (rows[0]["column"], rows[0].missing) == ("campaignIndex", 1)
    assert {r["column"]: r.dtype for r in rows}["rrp"] == "double"


def test_leakage_policies_drop_their_columns(interactions):
    left = cleaning.drop_leakage(interactions, "actions").columns
    assert left == ["day", "pid", "adFlag", "availability", "competitorPrice", "price"]


def test_valid_actions_raises_with_examples(spark, interactions):
    bad = spark.createDataFrame([(50, 1, 10, 0, 1, 1.0, 1, 1, 0, 1.0, 0.0)], schema.INTERACTIONS)
    mixed = interactions.unionByName(bad)
    assert cleaning.valid_actions(mixed).count() == 9
    with pytest.raises(ValueError, match="lineID=50"):
        cleaning.valid_actions(mixed, on_bad="raise")


def test_require_range(interactions):
    assert cleaning.require_range(interactions, "day", 1, 92) is interactions
    with pytest.raises(ValueError):
        cleaning.require_range(interactions, "day", 2, 92)
