import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    """Folder of the smallest tables."""
    return str(DATA / "sf0.001")


@pytest.fixture
def strict():
    """Parameters under which only the data stops growth."""
    return {
        "max_depth": None, "min_samples_leaf": 1, "min_impurity_decrease": 0.0, "inner_max_leaf_nodes": 8, "inner_min_samples_leaf": 1,
        "inner_min_impurity_decrease": 0.0, "coordinate_descent_max_iters": 20,
    }
