"""Metrics: coverage of a corpus of responses, and recall of the rules on labelled graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potflow.operators.labelled import suite
from potflow.operators.parsing import parsed_table, response_graphs
from potflow.operators.rules import verified
from potflow.sources.tables import written


def reported(parsed: DataFrame) -> DataFrame:
    """(response_id, recipe_id, attempt, status, category, failure_code, failure_detail, dish_name, is_valid,
    violations), one row per response; is_valid and violations (rule names, repeats kept) are null unless it was parsed.
    Parsing is done once and written."""
    parsed = written(parsed, "parsed")
    rules = F.transform("violations", lambda v: v["rule"]).alias("violations")
    verdicts = verified(response_graphs(parsed)).select(F.col("recipe_id").alias("response_id"), "is_valid", rules)
    return parsed.drop("nodes", "pairs").join(verdicts, "response_id", "left")


def counters(report: DataFrame) -> DataFrame:
    """One row of counts and shares. Shares of an empty whole are null."""
    n = lambda test: F.count_if(F.expr(test))
    counts = report.agg(
        F.count("*").alias("n_attempted"), n("status = 'success'").alias("n_parse_success"), n("status = 'out_of_scope'").alias("n_out_of_scope"),
        n("status = 'failed'").alias("n_parse_failed"), n("is_valid").alias("n_valid"), n("NOT is_valid").alias("n_invalid"),
    )
    share = lambda part, whole: F.round(100 * F.try_divide(F.col(part), F.col(whole)), 1)
    return counts.select(
        "*", share("n_out_of_scope", "n_attempted").alias("pct_out_of_scope"), share("n_parse_failed", "n_attempted").alias("pct_failed"),
        share("n_parse_success", "n_attempted").alias("pct_success"), share("n_valid", "n_parse_success").alias("pct_valid"), share("n_invalid", "n_parse_success").alias("pct_invalid"),
    )


def histogram(report: DataFrame, column: Column, name: str) -> DataFrame:
    """(name, n, place): values by descending number, equal ones by name. Places are counted after the aggregation, in one
    task: for columns with a fixed set of values, as categories, rules and failure codes are."""
    from pyspark.sql import Window

    counts = report.select(column.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name)))


def failure_reasons(report: DataFrame) -> DataFrame:
    """(failure_reason, n): failures by code and detail, as many rows as there are different details."""
    reason = F.concat_ws(": ", "failure_code", "failure_detail").alias("failure_reason")
    return report.where("failure_code IS NOT NULL").groupBy(reason).agg(F.count("*").alias("n"))


def summary(report: DataFrame) -> DataFrame:
    """One row (document): counts, shares and the numbers by category, rule and reason as one JSON object."""
    members = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias("m")
    maps = {
        "categories": category_histogram(report).agg(members("category")),
        "violation_counts": rule_histogram(report).agg(members("rule")),
        "failure_reasons": failure_reasons(report).agg(members("failure_reason")),
    }
    counts = counters(report)
    whole = counts.select(F.struct(*counts.columns, *(df.scalar().alias(name) for name, df in maps.items())).alias("s"))
    return whole.select(F.to_json("s", {"pretty": "true"}).alias("document"))


def category_histogram(report: DataFrame) -> DataFrame:
    return histogram(report, F.when(F.col("status") == "success", F.col("category")), "category")


def failure_histogram(report: DataFrame) -> DataFrame:
    return histogram(report, F.col("failure_code"), "failure_code")


def rule_histogram(report: DataFrame) -> DataFrame:
    return histogram(report.select(F.explode("violations").alias("rule")), F.col("rule"), "rule")


def case_results(labelled: DataFrame, verdicts: DataFrame) -> DataFrame:
    """labelled(case_name, recipe_id, expected_rule; "none" for a control) -> with fired rules, outcome (TP, FN, FP, TN)
    and a status in words. More rules than the expected one don't make a false positive."""
    fired = verdicts.select("recipe_id", "is_valid", F.array_sort(F.array_distinct(F.transform("violations", lambda v: v["rule"]))).alias("fired"))
    rows = labelled.join(fired, "recipe_id", "left").withColumn("fired", F.coalesce("fired", F.expr("cast(array() AS array<string>)")))
    control, names = F.col("expected_rule") == "none", F.array_join("fired", ", ")
    outcome = F.when(control, F.when(F.coalesce("is_valid", F.lit(True)), "TN").otherwise("FP")).when(F.array_contains("fired", F.col("expected_rule")), "TP").otherwise("FN")
    status = (
        F.when(F.col("outcome") == "TN", "✓ no false positive").when(F.col("outcome") == "FP", F.concat(F.lit("✗ FALSE POSITIVE: "), names))
        .when(F.col("outcome") == "TP", "✓ caught").otherwise(F.concat(F.lit("✗ MISSED (got: "), F.coalesce(F.nullif(names, F.lit("")), F.lit("nothing")), F.lit(")")))
    )
    return rows.withColumn("outcome", outcome).withColumn("status", status).withColumn("fired", names).select("case_name", "expected_rule", "fired", "outcome", "status")


def recall_by_rule(results: DataFrame) -> DataFrame:
    return results.where("expected_rule != 'none'").groupBy("expected_rule").agg(F.count_if(F.col("outcome") == "TP").alias("tp"), F.count_if(F.col("outcome") == "FN").alias("fn"))


def recall_summary(results: DataFrame) -> DataFrame:
    n = lambda test: F.count_if(F.expr(test))
    counts = results.agg(
        F.count("*").alias("n_total"), n("expected_rule != 'none'").alias("n_violation_cases"), n("expected_rule = 'none'").alias("n_control_cases"),
        n("outcome = 'TP'").alias("true_positives"), n("outcome = 'FN'").alias("false_negatives"), n("outcome = 'FP'").alias("false_positives"),
    )
    return counts.withColumn("recall", F.coalesce(F.try_divide("true_positives", "n_violation_cases"), F.lit(0.0)))


def suite_results(spark) -> DataFrame:
    from potflow.operators.graphs import nested

    labelled, recipes, nodes, edges = suite(spark)
    return case_results(labelled, verified(nested(recipes, nodes, edges)))


def coverage_report(spark, sf_dir: str) -> DataFrame:
    return reported(parsed_table(spark, sf_dir))
