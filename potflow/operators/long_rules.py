"""The rules on graphs of any size: joins on the long tables, reachability as a loop over frontiers.

operators.rules evaluates a graph in one row, which is faster for graphs of up to IN_ROW nodes and edges. Here no row and no
task holds a whole graph. A loop takes as many rounds as the longest shortest way; each round is a join of the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potflow.operators import rules
from potflow.operators.vocabulary import HEAT, IN_LIQUID
from potflow.sources.tables import dropped, written

#: Nodes and edges up to which a recipe is evaluated in one row: about 2 MB, a second of work at most.
IN_ROW = 5_000


def reached(seeds: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """seeds(keys, node_id) and all nodes that steps(recipe_id, node_id, to) lead to from them; keys include recipe_id."""
    spark = seeds.sparkSession
    frontier = written(seeds.select(*keys, "node_id").distinct(), "frontier")
    kind, places = frontier.schema, [frontier.written_to.toString()]
    while True:
        seen = spark.read.schema(kind).parquet(*places)  # what was reached, round by round; one scan, so that plans don't grow
        if frontier.isEmpty():
            return seen
        new = frontier.join(steps, ["recipe_id", "node_id"]).select(*keys, F.col("to").alias("node_id")).distinct()
        frontier = written(new.join(seen, [*keys, "node_id"], "left_anti"), "frontier")
        places.append(frontier.written_to.toString())


def unranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(recipe_id, node_id) of the nodes on or behind a cycle: what is left when nodes without open in-edges are taken off."""
    rest = written(nodes.select("recipe_id", "node_id"), "rest")
    open_edges = edges.select("recipe_id", "src", "dst").distinct()
    while True:
        left = written(open_edges.join(rest.withColumnRenamed("node_id", "src"), ["recipe_id", "src"], "left_semi"), "open")
        held = written(rest.join(left.select("recipe_id", F.col("dst").alias("node_id")), ["recipe_id", "node_id"], "left_semi"), "rest")
        if held.count() == rest.count():
            return held
        dropped(open_edges, rest)
        open_edges, rest = left, held


def violations(recipes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long tables -> (recipe_id, rule_ord, rule, message, nodes), what operators.rules gives, nodes comma-separated.

    Edges with an end that no node has are left out, as are nodes and edges of unknown recipes.
    """
    nodes = written(nodes.join(recipes.select("recipe_id"), "recipe_id", "left_semi"), "nodes")
    ends = nodes.select("recipe_id", "node_id", "pos", "node_type", "name", "category", "is_protein", "is_liquid", "op_type", "grp")
    side = lambda end: ends.select("recipe_id", *(F.col(c).alias(end if c == "node_id" else f"{end}_{c}") for c in ends.columns[1:]))
    edges = written(edges.join(side("src"), ["recipe_id", "src"]).join(side("dst"), ["recipe_id", "dst"]), "edges")
    ops, ingredients, outputs = (nodes.where(F.col("node_type") == k) for k in ("operation", "ingredient", "dish_output"))
    none = F.lit("")

    def found(rows: DataFrame, order: int, rule: str, message: Column, at: Column) -> DataFrame:
        return rows.select("recipe_id", F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule"), message.alias("message"), at.alias("nodes"))

    counts = recipes.join(outputs.groupBy("recipe_id").count(), "recipe_id", "left").withColumn("k", F.coalesce("count", F.lit(0))).where("k != 1")
    back = written(edges.where(F.coalesce(F.col("src_pos") >= F.col("dst_pos"), F.lit(True))).select("recipe_id").distinct(), "back")  # every cycle has such an edge
    looped = recipes.join(unranked(*(df.join(back, "recipe_id", "left_semi") for df in (nodes, edges))).select("recipe_id").distinct(), "recipe_id", "left_semi") if not back.isEmpty() else None
    own = lambda rows, among: rows.join(among.select("recipe_id").distinct(), "recipe_id", "left_semi")
    first = own(outputs.groupBy("recipe_id").agg(F.min_by("node_id", "pos").alias("node_id")), ingredients.where("is_protein"))
    unheated = edges.where(~F.coalesce(F.col("src_grp").isin(*HEAT), F.lit(False))).select("recipe_id", F.col("dst").alias("node_id"), F.col("src").alias("to"))
    raw = ingredients.where("is_protein").join(reached(first, unheated, ["recipe_id"]), ["recipe_id", "node_id"], "left_semi")
    plates = edges.where("src_op_type = 'plate' AND src_node_type = 'operation'").select("recipe_id", F.col("src").alias("plate"), F.col("dst").alias("node_id"))
    plates = own(plates, ops.where(F.col("grp").isin(*HEAT)))
    after = reached(plates, edges.select("recipe_id", F.col("src").alias("node_id"), F.col("dst").alias("to")), ["recipe_id", "plate"])
    heated = after.join(ops.where(F.col("grp").isin(*HEAT)).select("recipe_id", "node_id", "op_type"), ["recipe_id", "node_id"])
    solid = edges.where("dst_node_type = 'operation' AND dst_op_type = 'blend' AND src_node_type = 'ingredient' AND NOT src_is_liquid")
    wet = "src_node_type = 'operation' OR src_node_type = 'ingredient' AND src_is_liquid"
    tasty = "src_node_type = 'operation' OR src_node_type = 'ingredient' AND NOT coalesce(src_category = 'seasoning', false)"
    flag = lambda test: F.coalesce(F.expr(test), F.lit(False)).cast("int")
    ends = edges.select("recipe_id", F.explode(F.array(
        F.struct(F.col("src").alias("node_id"), *(F.lit(x).alias(c) for c, x in (("k_out", 1), ("k", 0), ("wet", 0), ("tasty", 0)))),
        F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("k_out"), F.lit(1).alias("k"), flag(wet).alias("wet"), flag(tasty).alias("tasty")),
    )).alias("e")).select("recipe_id", "e.*")
    sums = ends.groupBy("recipe_id", "node_id").agg(*(F.sum(c).alias(c) for c in ("k_out", "k", "wet", "tasty")))
    known = nodes.join(sums, ["recipe_id", "node_id"], "left").fillna(0, ["k_out", "k", "wet", "tasty"])
    told = lambda message, **parts: F.expr(rules.said(message, **parts))
    op, is_op = F.col("op_type"), F.col("node_type") == "operation"
    alone = [
        ((F.col("node_type") == "dish_output") & (F.col("k_out") > 0), 0, "dag_structure", told(rules.GOES_ON), none),
        ((F.col("node_type") == "ingredient") & (F.col("k_out") == 0), 0, "dag_structure", told(rules.UNUSED, name="name", id="node_id"), none),
        (is_op & op.isin(*IN_LIQUID) & (F.col("wet") == 0), 4, "moist_heat_needs_liquid", told(rules.DRY, op="op_type"), F.col("node_id")),
        (is_op & op.isin("combine", "mix", "toss") & (F.col("k") < 2), 5, "combine_needs_multiple_inputs", told(rules.FEW, op="op_type", k="k"), F.col("node_id")),
        (is_op & (F.col("k_out") == 0), 6, "no_dangling_outputs", told(rules.OPEN, op="op_type", id="node_id"), F.col("node_id")),
        (is_op & (op == "season") & (F.col("tasty") == 0), 7, "season_needs_target", told(rules.NO_TARGET), F.col("node_id")),
    ]  # what a node and its own edges tell: one join, whichever rules there are
    each = F.array(*(F.when(test, F.struct(F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule"), message.alias("message"), at.alias("nodes"))) for test, order, rule, message, at in alone))
    rows = [
        found(counts, 0, "dag_structure", told(rules.OUTPUTS, k="k"), none),
        *([found(looped, 0, "dag_structure", told(rules.LOOP, dish="dish_name"), none)] if looped else []),
        found(raw, 1, "raw_protein_before_plate", told(rules.RAW, name="name"), F.col("node_id")),
        found(solid, 2, "solid_before_blend", told(rules.SOLID, name="src_name"), F.concat_ws(",", "src", "dst")),
        found(heated, 3, "no_heat_after_plate", told(rules.LATE_HEAT, op="op_type"), F.concat_ws(",", "plate", "node_id")),
        known.select("recipe_id", F.explode(each).alias("v")).where("v IS NOT NULL").select("recipe_id", "v.*"),
    ]
    return reduce(DataFrame.unionByName, rows)


def of_any_size(recipes: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = IN_ROW) -> DataFrame:
    """violations, with the recipes of up to ``most`` nodes and edges evaluated in a row each and the larger ones by joins.

    Sizes are counted first, on two columns; if no recipe is larger, nothing else is added to the plan.
    """
    ends = nodes.select("recipe_id").unionByName(edges.select("recipe_id"))
    large = written(ends.groupBy("recipe_id").count().where(F.col("count") > most).select("recipe_id"), "large")
    own = lambda df, how: df.join(large, "recipe_id", how)
    some = not large.isEmpty()
    small = [own(df, "left_anti") for df in (recipes, nodes, edges)] if some else [recipes, nodes, edges]
    rows = rules.violations(rules.verified(rules.nested(*small))).withColumn("nodes", F.array_join("node_ids", ",")).drop("node_ids")
    return rows.unionByName(violations(*(own(df, "left_semi") for df in (recipes, nodes, edges)))) if some else rows
