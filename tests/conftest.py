import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "/tmp/meridia-checkpoints")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/meridia-warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def one(spark):
    """The value of a column function for one value."""
    from pyspark.sql import functions as F

    def run(value, f, kind="string"):
        return spark.createDataFrame([(value,)], f"s {kind}").select(f(F.col("s")).alias("o")).first().o

    return run
