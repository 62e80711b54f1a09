"""Command lines: ``python -m potflow coverage`` and ``python -m potflow recall``."""

from __future__ import annotations

import argparse
import importlib
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potflow.operators import evaluation
from potflow.operators.parsing import parse
from potflow.operators.rules import verdict_texts, verified
from potflow.operators.vocabulary import dim_ingredient, dim_operation, system_prompt, user_prompt
from potflow.sources import json_io, replay
from potflow.sources.tables import written


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="potflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    coverage = commands.add_parser("coverage", help="parse and verify the recorded responses of a sample of a corpus")
    coverage.add_argument("--corpus-path", required=True, help="the corpus, a JSON array of records")
    coverage.add_argument("--responses", required=True, help="recorded responses: Parquet with prompt_hash and raw")
    coverage.add_argument("--n", type=int, default=200)
    coverage.add_argument("--partition", default="test")
    coverage.add_argument("--client", help="module:function that takes the system prompt and gives a client; asked where nothing is recorded")
    coverage.add_argument("--endpoint", help="instead of a client, the address of a chat completions service")
    coverage.add_argument("--model", default="sonar", help="the model that the service is asked for")
    coverage.add_argument("--key-variable", default="API_KEY", help="environment variable with the service's key")
    coverage.add_argument("--delay", type=float, default=0.5, help="seconds between two calls, over all tasks")
    coverage.add_argument("--out", default="data/coverage_results", help="folder for the rows (recipes) and one document of counts (summary)")
    coverage.add_argument("--shared", help="folder that all executors share, if the session names none in spark.checkpoint.dir; in local mode a temporary one is made")
    coverage.add_argument("--verbose", action="store_true")
    commands.add_parser("recall", help="recall of the rules on the labelled suite").add_argument("--verbose", action="store_true")
    return parser.parse_args(args)


def coverage(spark: SparkSession, corpus_path: str, responses: DataFrame, n: int, partition: str, client: Callable[..., Callable[[str], str]] | None = None, delay: float = 0.5) -> DataFrame:
    """The report of a sample of a corpus, a row per recipe with its title, with recorded responses. A prompt without one is
    put to the client, with the system prompt and ``delay`` seconds between two calls; without a client it is an api_error."""
    chosen = json_io.sampled(json_io.read_corpus(spark, corpus_path, partition), n)
    texts = lambda c: F.filter(F.coalesce(F.col(f"{c}.text"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    prompt = user_prompt(F.coalesce("title", F.lit("")), texts("ingredients"), texts("instructions"))
    prompts = chosen.select(F.coalesce("id", F.lit("")).alias("recipe_id"), prompt.alias("prompt"), replay.prompt_hash(prompt).alias("prompt_hash"))
    raw = replay.replayed(prompts, responses)
    if client:
        system = system_prompt(dim_ingredient(spark), dim_operation(spark)).first()["prompt"]
        missing = prompts.join(responses.where("raw IS NOT NULL"), "prompt_hash", "left_anti")
        asked = written(replay.asked(missing, client, pause=delay, system=system), "asked")
        raw = raw.where("raw IS NOT NULL").unionByName(asked.drop("prompt"), allowMissingColumns=True)
    raw = raw.select(F.col("recipe_id").alias("response_id"), "recipe_id", F.lit(1).alias("attempt"), "raw")
    titles = chosen.select(F.coalesce("id", F.lit("")).alias("recipe_id"), F.coalesce("title", F.lit("")).alias("title"))
    return evaluation.reported(parse(raw, dim_ingredient(spark))).join(titles, "recipe_id", "left")


def main(args: list[str]) -> None:
    options = arguments(args)
    spark = SparkSession.builder.appName("potflow").getOrCreate()
    if options.command == "recall":
        results = evaluation.suite_results(spark)
        results.select("case_name", "expected_rule", "status").orderBy("case_name").show(100, False)
        if options.verbose:
            _, recipes, nodes, edges = evaluation.suite(spark)
            from potflow.operators.graphs import nested

            verdict_texts(verified(nested(recipes, nodes, edges))).orderBy("recipe_id").show(100, False)
        evaluation.recall_by_rule(results).orderBy("expected_rule").show(100, False)
        evaluation.recall_summary(results).show(1, False)
        return
    if spark.conf.get("spark.checkpoint.dir", None) is None and (options.shared or spark.sparkContext.master.split("[")[0] == "local"):
        spark.conf.set("spark.checkpoint.dir", options.shared or f"file://{tempfile.mkdtemp(prefix='potflow-')}")
    module, _, name = (options.client or "").partition(":")
    client = getattr(importlib.import_module(module), name) if module else None
    if options.endpoint and not client:
        client = replay.chat_client(options.endpoint, options.model, options.key_variable)
    report = coverage(spark, options.corpus_path, spark.read.parquet(options.responses), options.n, options.partition, client, options.delay)
    json_io.write_results(report, f"{options.out}/recipes")
    report = spark.read.schema(report.schema).json(f"{options.out}/recipes")
    evaluation.summary(report).coalesce(1).write.mode("overwrite").text(f"{options.out}/summary")
    if options.verbose:
        report.select("recipe_id", "title", "status", "failure_code", "is_valid", F.slice("violations", 1, 3).alias("violations")).show(options.n, False)
    evaluation.counters(report).show(1, False)
    for histogram in (evaluation.category_histogram, evaluation.rule_histogram):
        histogram(report).orderBy("place").show(100, False)
    evaluation.failure_reasons(report).orderBy(F.desc("n"), "failure_reason").show(100, False)


if __name__ == "__main__":
    main(sys.argv[1:])
