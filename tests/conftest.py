import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marketgauge import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def interactions(spark):
    """lineID, day, pid, adFlag, availability, competitorPrice, click, basket, order, price,
    revenue: a gap in days, two prices on one day, a product seen once, one without an item."""
    rows = [
        (1, 1, 10, 0, 1, 12.0, 1, 0, 0, 10.0, 0.0),
        (2, 1, 10, 1, 1, 8.0, 0, 0, 1, 11.0, 22.0),
        (3, 3, 10, 0, 2, 10.0, 0, 0, 1, 10.0, 10.0),
        (4, 7, 10, 1, 2, 0.0, 0, 1, 0, 9.0, 0.0),
        (5, 26, 10, 0, 3, None, 0, 0, 1, 12.0, 48.0),
        (6, 2, 20, 0, 4, -1.0, 1, 0, 0, 5.0, 0.0),
        (7, 30, 20, 1, 1, 4.0, 0, 0, 1, 5.0, 35.0),
        (8, 5, 30, 0, 1, 6.0, 1, 0, 0, 6.0, 0.0),
        (9, 6, 99, 0, 1, 7.0, 1, 0, 0, 7.0, 0.0),
    ]
    return spark.createDataFrame(rows, schema.INTERACTIONS)


@pytest.fixture
def items(spark):
    rows = [
        (10, "m1", "g1", "5X10", "ST", " tab ", 0, 40, 7, "A", 20.0),
        (20, "m1", "g2", "10", "ML", None, 1, 44, None, None, 5.0),
        (30, "m2", "g1", "PAK", "ST", "Cap", 0, 52, 9, "C", 6.0),
    ]
    return spark.createDataFrame(rows, schema.ITEMS)
