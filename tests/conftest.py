import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def save(spark, tmp_path):
    """Writes tables to a folder laid out like the test data and gives the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


LAYER1 = "id string, partition string, title string, ingredients array<struct<text: string>>, instructions array<struct<text: string>>, site string, crawled_at timestamp_ntz, loaded_at timestamp_ntz, removed_at timestamp_ntz"


@pytest.fixture
def layer1(spark):
    """Makes layer1 rows from (id, title, ingredients, instructions, loaded_at, removed_at)."""
    from datetime import datetime

    def make(rows, extra=()):
        full = []
        for rid, title, ings, steps, loaded, *removed in rows:
            wrap = lambda xs: None if xs is None else [None if x is False else (x,) for x in xs]
            full.append((rid, "train", title, wrap(ings), wrap(steps), "s1", None, datetime(2024, 1, loaded), datetime(2024, 1, removed[0]) if removed and removed[0] else None))
        df = spark.createDataFrame(full, LAYER1)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
