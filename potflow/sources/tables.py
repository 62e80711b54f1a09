"""Parquet tables, keys, current rows and intermediate tables."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str | Column) -> Column:
    """A recipe or node key as it is compared and given out: trimmed, lower case."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))


def current(layer1: DataFrame) -> DataFrame:
    """One row per recipe: the latest by loaded_at, its id trimmed and in lower case.

    Rows without id are left out. Equal loaded_at (exact copies) are settled by a hash of the columns given, so the result
    doesn't depend on the partitioning; who needs few columns selects them before, and the others aren't read. The rank
    filter lets Spark drop old versions before the shuffle, so an id with very many versions costs one row per map task.
    """
    rows = layer1.where(F.col("id").isNotNull()).withColumn("id", key("id"))
    content = F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) if t.startswith(("map", "variant")) else F.col(c) for c, t in rows.dtypes))
    latest = Window.partitionBy("id").orderBy(F.desc("loaded_at"), F.desc(content))
    return rows.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """A scan with enough partitions to occupy every core in a Python stage; larger scans stay as they are."""
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A session that names none must be told one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back. Cuts the lineage; lost executors cost no recomputation.

    The files are removed when the driver's JVM ends, or by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/potflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, path = _files(spark, path)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(path.toString())
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave and no plan needs any more; others, also those made from such, stay."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            _files(df.sparkSession, path.toString())[0].delete(path, True)


def released(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to: the executors' shuffle files of plans that have run stay until then."""
    gc.collect()
    spark._jvm.System.gc()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path
