import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import get_spark  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tidemark-tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def transactions(spark, sf_small):
    from tidemark.queries.base import transactions

    return transactions(spark, sf_small).cache()


@pytest.fixture
def rows(spark):
    """Frame from a list of tuples and a schema string."""

    def make(data, schema, partitions=None):
        df = spark.createDataFrame(data, schema)
        return df.repartition(partitions) if partitions else df

    return make
