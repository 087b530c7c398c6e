import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def docs(spark):
    """doc_id, text, source, lang and an extra column whose name clashes."""

    def make(rows, schema="doc_id long, text string, source string, lang string, size string, n_tokens string, label string"):
        return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], schema)

    return make
