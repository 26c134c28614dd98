import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def matrix_of(spark, cells, users, items):
    from loomrec.sources.triplets import Interactions

    x = spark.createDataFrame([(int(u), int(i), float(v)) for u, i, v in cells], "user_id long, item_id long, value double")
    return Interactions(
        x,
        spark.createDataFrame([(int(u),) for u in users], "user_id long"),
        spark.createDataFrame([(int(i),) for i in items], "item_id long"),
    )


@pytest.fixture(scope="session")
def ladder(spark):
    """User u has items u, u + 1, u + 2."""
    return matrix_of(spark, [(u, u + d, 1) for u in range(1, 9) for d in range(3)], range(1, 9), range(1, 11)).settled()


@pytest.fixture(scope="session")
def ratings(spark):
    return matrix_of(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 3, 4), (3, 2, 2), (3, 3, 4)], range(1, 4), range(1, 4)).settled()


@pytest.fixture(scope="session")
def random_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    mask = rng.random((40, 25)) < 0.2
    cells = [(u + 1, i + 1, float(rng.integers(1, 6))) for u, i in zip(*np.nonzero(mask))]
    return matrix_of(spark, cells, range(1, 41), range(1, 26)).settled()


def dense(matrix, n_users, n_items):
    import numpy as np

    out = np.zeros((n_users, n_items))
    for r in matrix.x.collect():
        out[r["user_id"] - 1, r["item_id"] - 1] = r["value"]
    return out


def lists(recs):
    out = {}
    for r in sorted(recs.collect(), key=lambda r: (r["user_id"], r["rank"])):
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out
