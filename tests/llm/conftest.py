import pytest
from llm_rows import CLASHING, SCHEMA, rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
