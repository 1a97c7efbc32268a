import pytest


@pytest.fixture
def table(spark):
    """A table from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
