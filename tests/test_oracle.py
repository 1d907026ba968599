"""Every checked query against its SQL on the smallest data folder."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# One or two per family by default; CHECK_ALL=1 takes all of them.
DEFAULT = ["features_core", "parse_content_int", "impute_median", "skew_safe_join",
           "rare_categories", "target_encode", "spline_basis", "expanding_history_pid",
           "category_rolling_7d", "price_position_buckets", "price_deciles", "price_conflicts",
           "order_autocorrelation", "cramers_v", "mutual_information", "split_by_day_share",
           "kfold_counts", "roc_auc", "threshold_cv", "operating_points", "baseline_mean",
           "knn_vote", "knn_k_search", "csv_roundtrip", "stratified_split_null",
           "stratified_split_drift", "oversample_null", "kfold_null",
           "binary_metrics_null_score", "threshold_cv_choice", "random_split", "preview_hash"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CHECK_ALL") else DEFAULT

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no data folder")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert verify.compare(spark, con, name, FOLDER).startswith("ok")
