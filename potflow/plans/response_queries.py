"""Queries on model responses: parsing, coverage, and recall on the labelled suite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators import evaluation
from potflow.operators.parsing import parsed_table


def parsed_nodes(spark, sf_dir: str) -> DataFrame:
    rows = parsed_table(spark, sf_dir).where("status = 'success'").select("recipe_id", "attempt", F.explode("nodes").alias("x"))
    params = F.from_json(F.concat(F.lit('{"p":'), "x.params", F.lit("}")), "p string")["p"].alias("params")  # without spaces
    return rows.select("recipe_id", "attempt", *(f"x.{c}" for c in ("node_id", "node_type", "name", "category", "is_protein", "is_liquid", "op_type", "grp")), params)


def parsed_edges(spark, sf_dir: str) -> DataFrame:
    rows = parsed_table(spark, sf_dir).where("status = 'success'").select("recipe_id", "attempt", F.explode("pairs").alias("x"))
    return rows.select("recipe_id", "attempt", "x.edge_seq", "x.src", "x.dst")


def coverage_report(spark, sf_dir: str) -> DataFrame:
    report = evaluation.coverage_report(spark, sf_dir).withColumn("violations", F.array_join("violations", ","))
    return report.select("recipe_id", "attempt", "status", "category", "failure_code", "is_valid", "violations")


QUERIES: dict[str, Callable] = {
    "parse_outcomes": lambda s, d: parsed_table(s, d).select("recipe_id", "attempt", "status", "category", "failure_code"),
    "parsed_nodes": parsed_nodes,
    "parsed_edges": parsed_edges,
    "coverage_report": coverage_report,
    "coverage_counters": lambda s, d: evaluation.counters(evaluation.coverage_report(s, d)),
    "category_histogram": lambda s, d: evaluation.category_histogram(parsed_table(s, d)),
    "failure_histogram": lambda s, d: evaluation.failure_histogram(parsed_table(s, d)),
    "failure_reasons": lambda s, d: evaluation.failure_reasons(parsed_table(s, d)),
    "rule_histogram": lambda s, d: evaluation.rule_histogram(evaluation.coverage_report(s, d)),
    "recall_cases": lambda s, d: evaluation.suite_results(s),
    "recall_by_rule": lambda s, d: evaluation.recall_by_rule(evaluation.suite_results(s)),
    "recall_summary": lambda s, d: evaluation.recall_summary(evaluation.suite_results(s)),
}
