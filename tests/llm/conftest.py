import pytest


@pytest.fixture(autouse=True, scope="session")
def few_partitions(spark):
    """The tables here are tiny: the time goes into tasks, not rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
