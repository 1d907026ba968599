"""What the searches of the model queries try."""

from marketgauge.catalog import QUERIES
from marketgauge.operators import models


def test_tuning_report_tries_both_grids(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(models, "tune_grid",
                        lambda df, label, grid, make: seen.update(grid=grid, make=make))
    QUERIES["tuning_report"](spark, "/root/testdata/sf0.001")
    forests = [seen["make"](**cell)[0] for cell in seen["grid"]]
    tried = [(f.getMaxDepth(), f.getMinInstancesPerNode(), f.getFeatureSubsetStrategy(),
              f.getNumTrees()) for f in forests]
    # An unlimited depth and 30 are the same to MLlib.
    assert sorted(tried[:4]) == [(30, 1, "sqrt", 100)] * 2 + [(30, 10, "sqrt", 100)] * 2
    assert sorted(tried[4:]) == [(30, 10, w, n) for w in ("0.3", "0.5", "sqrt")
                                 for n in (100, 200, 300)]
