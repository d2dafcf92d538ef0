import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from workload.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a Column function over literal rows of strings."""

    def run(rows, build, schema="a string"):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return [r[0] for r in df.select(build(df).alias("out")).collect()]

    return run
