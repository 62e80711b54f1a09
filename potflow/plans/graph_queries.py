"""Queries on the process graphs of the tables recipes, nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators import graphs, long_rules, rules, vocabulary
from potflow.operators.graphs import LABEL, long_form
from potflow.operators.rules import table_verdicts
from potflow.plans import derived
from potflow.sources.tables import table


def nested(spark, sf_dir: str) -> DataFrame:
    return graphs.nested(*long_form(spark, sf_dir, spread=True))


def violation_rows(spark, sf_dir: str) -> DataFrame:
    return rules.violations(table_verdicts(spark, sf_dir))


def joined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nodes", F.array_join("node_ids", ",")).drop("node_ids")


def one_rule(name: str) -> Callable:
    """A rule alone: the other rules' expressions aren't evaluated."""

    def query(spark, sf_dir: str) -> DataFrame:
        verdicts = rules.verified(nested(spark, sf_dir), rules.RuleRegistry().only(name))
        return joined(rules.violations(verdicts)).select("recipe_id", "message", "nodes")

    return query


def levels(spark, sf_dir: str) -> DataFrame:
    return level_rows(nested(spark, sf_dir))


def violation_counts(verdicts: DataFrame) -> DataFrame:
    """(rule, n): violations per rule, and recipes under the name "recipes", valid ones under "valid". One pass."""
    names = F.expr("concat(array('recipes'), CASE WHEN is_valid THEN array('valid') ELSE cast(array() AS array<string>) END, transform(violations, v -> v.rule))")
    return verdicts.select(names.alias("names")).select(F.explode_outer("names").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def level_rows(graph_rows: DataFrame) -> DataFrame:
    """Length of the longest way to each node that isn't on or behind a cycle."""
    rows = graphs.with_order(graph_rows).select("recipe_id", "ids", F.arrays_zip("topo", "levels").alias("x"))
    rows = graphs.exploded(rows, "x", "y").select("recipe_id", "ids", "y.topo", "y.levels")
    return rows.select("recipe_id", F.expr("ids[topo]").alias("node_id"), F.col("levels").alias("level"))


def reach(column: str) -> Callable:
    def query(spark, sf_dir: str) -> DataFrame:
        rows = graphs.analysed(nested(spark, sf_dir))
        if column == "unheated":
            return graphs.exploded(rows, "unheated", "i").select("recipe_id", F.expr("ids[i]").alias("node_id"))
        pairs = graphs.exploded(graphs.exploded(rows, "after_plates", "p").select("recipe_id", "ids", "p.plate", "p.after"), "after", "i")
        return pairs.select("recipe_id", F.expr("ids[plate]").alias("plate"), F.expr("ids[i]").alias("node_id"))

    return query


def on(which: str, f: Callable[..., DataFrame]) -> Callable:
    """A query that applies f to some of the long tables r, n, e."""

    def query(spark, sf_dir: str) -> DataFrame:
        tables = dict(zip("rne", long_form(spark, sf_dir)))
        return f(*(tables[t] for t in which))

    return query


def operation_meta(n: DataFrame) -> DataFrame:
    meta = vocabulary.dim_operation(n.sparkSession)
    return n.where("node_type = 'operation'").select("recipe_id", "node_id", "op_type").join(F.broadcast(meta), "op_type").select("recipe_id", "node_id", *meta.columns)


def arity_violations(n: DataFrame, e: DataFrame) -> DataFrame:
    """Operations with fewer or more inputs than their metadata allow."""
    meta = vocabulary.dim_operation(n.sparkSession).select("op_type", "min_inputs", "max_inputs")
    known = e.join(n.select("recipe_id", F.col("node_id").alias("src")), ["recipe_id", "src"])
    counts = graphs.degrees(n, known).select("recipe_id", "node_id", F.col("n_in").alias("n_inputs"))
    rows = n.where("node_type = 'operation'").join(counts, ["recipe_id", "node_id"]).join(F.broadcast(meta), "op_type")
    return rows.where("n_inputs < min_inputs OR max_inputs > 0 AND n_inputs > max_inputs").select("recipe_id", "node_id", "op_type", "n_inputs")


def unknown_ingredients(spark, sf_dir: str) -> DataFrame:
    """Names of ingredient nodes outside the reference vocabulary, with their category and number."""
    n = long_form(spark, sf_dir)[1].where("node_type = 'ingredient'").withColumn("vocab_key", F.lower(F.replace("name", F.lit(" "), F.lit("_"))))
    known = table(spark, sf_dir, "dim_ingredient").select("vocab_key")
    return n.join(known, "vocab_key", "left_anti").groupBy("name", "category").agg(F.count("*").alias("n"))


def report(spark, sf_dir: str) -> DataFrame:
    verdicts = table_verdicts(spark, sf_dir)
    return verdicts.withColumn("violations", F.array_join(F.transform("violations", lambda v: v["rule"]), ","))


QUERIES: dict[str, Callable] = {
    "verify_verdicts": lambda s, d: table_verdicts(s, d).withColumn("n_violations", F.size("violations")).drop("violations"),
    "violations": lambda s, d: long_rules.of_any_size(*long_form(s, d, spread=True)),
    "violations_by_joins": lambda s, d: long_rules.violations(*long_form(s, d)),
    "topological_order": lambda s, d: graphs.topological(nested(s, d)),
    "topological_levels": levels,
    "cycles": lambda s, d: graphs.cyclic(nested(s, d)),
    "degrees": on("ne", graphs.degrees),
    "unheated_paths": reach("unheated"),
    "after_plate": reach("after"),
    "successors": on("ne", lambda n, e: graphs.neighbours(n, e, "src")),
    "predecessors": on("ne", lambda n, e: graphs.neighbours(n, e, "dst")),
    "broken_edges": on("ne", graphs.broken_edges),
    "all_nodes": on("n", lambda n: n),
    "ingredient_nodes": on("n", lambda n: n.where("node_type = 'ingredient'").select("recipe_id", "node_id", "pos", "name", "category")),
    "operation_nodes": on("n", lambda n: n.where("node_type = 'operation'").select("recipe_id", "node_id", "pos", "op_type")),
    "first_outputs": on("n", graphs.first_outputs),
    "names_and_operations": on("n", graphs.listed),
    "labels": on("n", lambda n: n.select("recipe_id", "node_id", F.expr(LABEL).alias("label"))),
    "operation_meta": on("n", operation_meta),
    "graph_summaries": on("rn", graphs.summaries),
    "graph_texts": lambda s, d: graphs.texts(nested(s, d)),
    "violation_texts": lambda s, d: violation_rows(s, d).select("recipe_id", "rule", rules.violation_text(F.col("rule"), F.col("message"), F.col("node_ids")).alias("text")),
    "verdict_texts": lambda s, d: rules.verdict_texts(table_verdicts(s, d)),
    "verdict_headers": lambda s, d: rules.verdict_texts(table_verdicts(s, d)).select("recipe_id", F.substring_index("text", "\n", 1).alias("header")),
    "violation_histogram": lambda s, d: violation_rows(s, d).groupBy("rule").agg(F.count("*").alias("n")),
    "recipe_report": report,
    "operation_transitions": on("ne", graphs.transitions),
    "arity_violations": on("ne", arity_violations),
    "edges_as_written": on("e", graphs.edges_as_written),
    "unknown_ingredients": unknown_ingredients,
    "rewrite_groups": lambda s, d: vocabulary.rewrite_groups(vocabulary.dim_operation(s)),
    "dim_operations": lambda s, d: vocabulary.dim_operation(s),
    "dim_ingredients": lambda s, d: vocabulary.dim_ingredient(s),
    "derived_verdicts": lambda s, d: rules.verified(derived.graphs(s, d)).withColumn("n_violations", F.size("violations")).drop("violations"),
    "derived_violations": lambda s, d: joined(rules.violations(rules.verified(derived.graphs(s, d)))),
    "derived_cycles": lambda s, d: graphs.cyclic(derived.graphs(s, d)),
    "derived_levels": lambda s, d: level_rows(derived.graphs(s, d)),
    "derived_summary": lambda s, d: violation_counts(rules.verified(derived.graphs(s, d))),
} | {f"rule_{r.name}": one_rule(r.name) for r in rules.RULES}
