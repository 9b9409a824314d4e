from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from doccat.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions over literal values: ``one(fn, a, b)``."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        row = spark.range(1).select(*(F.lit(v).alias(f"v{i}") for i, v in enumerate(values)))
        return row.select(fn(*(F.col(f"v{i}") for i in range(len(values)))).alias("r")).first()["r"]

    return run
