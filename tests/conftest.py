import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from skein.session import local_session

    s = local_session(4, 4, "4g", "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """rows, schema -> DataFrame"""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
