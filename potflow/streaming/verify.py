"""Verdicts on streams of responses and of nested graphs. Both operators look at one row at a time, so they keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potflow.operators.graphs import indexed
from potflow.operators.parsing import NODES_DDL, PAIRS_DDL, parse
from potflow.operators.rules import RuleRegistry, verified

RESPONSES = "recipe_id string, attempt int, prompt_hash string, raw string, received_at timestamp_ntz"
GRAPHS = f"recipe_id string, dish_name string, category string, nodes {NODES_DDL}, pairs {PAIRS_DDL}"


def response_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RESPONSES).parquet(folder)


def verdict_stream(responses: DataFrame, ingredients: DataFrame, registry: RuleRegistry | None = None) -> DataFrame:
    """A stream of responses -> a stream of verdicts of those that parse; ingredients is a static table."""
    keyed = responses.withColumn("response_id", F.md5(F.to_json(F.struct("recipe_id", "attempt", "raw"))))
    rows = parse(keyed, ingredients).where("status = 'success'").select(F.col("response_id").alias("recipe_id"), "dish_name", "category", "nodes", "pairs")
    return verified(indexed(rows), registry)


def graph_stream(graphs: DataFrame, registry: RuleRegistry | None = None) -> DataFrame:
    """A stream of nested graphs (GRAPHS) -> a stream of verdicts."""
    return verified(indexed(graphs), registry)


def arrivals(responses: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Responses and failed calls (raw null) per window of received_at; rows more than ``late`` behind the newest are
    left out."""
    timed = responses.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(F.col("raw").isNull()).alias("n_failed"))
