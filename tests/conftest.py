import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    import os

    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/checkpoints/foliant-tests").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def no_tables_left():
    """What a test stores goes with it."""
    from foliant import storage

    with storage.scratch():
        yield
