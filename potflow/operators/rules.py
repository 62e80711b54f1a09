"""Rules on process graphs and the verdicts they give.

A rule is an SQL expression over a nested graph row (see graphs.analysed) that gives array<struct<message, node_ids>>.
All rules are evaluated in one projection over the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators.graphs import analysed, exploded, long_form, nested

_NONE = "cast(array() AS array<struct<message: string, node_ids: array<string>>>)"
_INPUTS = "filter(edges, e -> e.d = i)"


@dataclass(frozen=True)
class Rule:
    """fires: an expression over nodes, ids, edges, n, heats, output, cyclic, unheated, after_plates."""

    order: int
    name: str
    fires: str


def per_operation(operations: str, test: str, message: str) -> str:
    """One violation for each operation node i among ``operations`` (a list in SQL, or all if empty) that meets ``test``."""
    among = f" AND nodes[i].op_type IN ({operations})" if operations else ""
    return f"transform(filter(sequence(0, n - 1), i -> nodes[i].node_type = 'operation'{among} AND {test}), i -> struct({message} AS message, array(ids[i]) AS node_ids))"


def guarded(fires: str) -> str:
    return f"CASE WHEN n = 0 THEN {_NONE} ELSE {fires} END"


#: The messages of the rules.
OUTPUTS = "Expected 1 DISH_OUTPUT node, found {k}"
LOOP = "RecipeDAG '{dish}' contains a cycle — not a valid DAG."
GOES_ON = "DISH_OUTPUT node has outgoing edges"
UNUSED = "Ingredient '{name}' ({id}) has no outgoing edges — unused"
RAW = "[FDA] Protein '{name}' reaches the dish without passing through any heat operation"
SOLID = "[DC] Solid ingredient '{name}' enters BLEND without any preparation"
LATE_HEAT = "[MILK/serve] Heat operation '{op}' appears after PLATE"
DRY = "[PHYS] '{op}' has no liquid input — moist heat requires a liquid medium"
FEW = "[MILK/combine] '{op}' has {k} input(s); requires ≥2"
OPEN = "[MILK/serve] Operation '{op}' ({id}) has no successors — output is never consumed"
NO_TARGET = "[DC] SEASON has no non-seasoning input"


def said(message: str, **parts: str) -> str:
    """The SQL of a message, its places filled with SQL expressions; null ones read None."""
    pieces = re.split(r"\{(\w+)\}", message)
    return "concat(" + ", ".join(f'"{x}"' if i % 2 == 0 else f"coalesce(cast({parts[x]} AS string), 'None')" for i, x in enumerate(pieces) if x) + ")"


_UNNAMED = "cast(array() AS array<string>)"
_COUNT = "size(filter(nodes, x -> x.node_type = 'dish_output'))"
_GIVEN = f"NOT exists({_INPUTS}, e -> nodes[e.s].node_type = 'operation' OR nodes[e.s].node_type = 'ingredient' AND "
STRUCTURE = f"""concat(
  CASE WHEN {_COUNT} != 1 THEN array(struct({said(OUTPUTS, k=_COUNT)} AS message, {_UNNAMED} AS node_ids)) ELSE {_NONE} END,
  CASE WHEN cyclic THEN array(struct({said(LOOP, dish="dish_name")} AS message, {_UNNAMED} AS node_ids)) ELSE {_NONE} END,
  CASE WHEN n = 0 THEN {_NONE} ELSE transform(filter(sequence(0, n - 1), i -> nodes[i].node_type = 'dish_output' AND exists(edges, e -> e.s = i)),
    i -> struct({said(GOES_ON)} AS message, {_UNNAMED} AS node_ids)) END,
  CASE WHEN n = 0 THEN {_NONE} ELSE transform(filter(sequence(0, n - 1), i -> nodes[i].node_type = 'ingredient' AND NOT exists(edges, e -> e.s = i)),
    i -> struct({said(UNUSED, name="nodes[i].name", id="ids[i]")} AS message, {_UNNAMED} AS node_ids)) END)"""

#: The rules in their order.
RULES = [
    Rule(0, "dag_structure", STRUCTURE),
    Rule(
        1,
        "raw_protein_before_plate",
        "transform(filter(sequence(0, n - 1), i -> nodes[i].node_type = 'ingredient' AND nodes[i].is_protein AND array_contains(unheated, i)), "
        f"i -> struct({said(RAW, name='nodes[i].name')} AS message, array(ids[i]) AS node_ids))",
    ),
    Rule(
        2,
        "solid_before_blend",
        "transform(filter(edges, e -> nodes[e.d].node_type = 'operation' AND nodes[e.d].op_type = 'blend' AND nodes[e.s].node_type = 'ingredient' AND NOT nodes[e.s].is_liquid), "
        f"e -> struct({said(SOLID, name='nodes[e.s].name')} AS message, array(ids[e.s], ids[e.d]) AS node_ids))",
    ),
    Rule(
        3,
        "no_heat_after_plate",
        "flatten(transform(after_plates, p -> transform(filter(p.after, h -> heats[h] AND nodes[h].node_type = 'operation'), "
        f"h -> struct({said(LATE_HEAT, op='nodes[h].op_type')} AS message, array(ids[p.plate], ids[h]) AS node_ids))))",
    ),
    Rule(4, "moist_heat_needs_liquid", per_operation("'boil', 'simmer', 'braise', 'poach'", _GIVEN + "nodes[e.s].is_liquid)", said(DRY, op="nodes[i].op_type"))),
    Rule(5, "combine_needs_multiple_inputs", per_operation("'combine', 'mix', 'toss'", f"size({_INPUTS}) < 2", said(FEW, op="nodes[i].op_type", k=f"size({_INPUTS})"))),
    Rule(6, "no_dangling_outputs", per_operation("", "NOT exists(edges, e -> e.s = i)", said(OPEN, op="nodes[i].op_type", id="ids[i]"))),
    Rule(7, "season_needs_target", per_operation("'season'", _GIVEN + "NOT coalesce(nodes[e.s].category = 'seasoning', false))", said(NO_TARGET))),
]


@dataclass
class RuleRegistry:
    """Rules by order and name; more can be added."""

    rules: list[Rule] = field(default_factory=lambda: list(RULES))

    def add(self, name: str, fires: str) -> Rule:
        if any(r.name == name for r in self.rules):
            raise ValueError(f"there is a rule {name}")
        rule = Rule(max((r.order for r in self.rules), default=-1) + 1, name, fires)
        self.rules.append(rule)
        return rule

    def only(self, *names: str) -> RuleRegistry:
        return RuleRegistry([r for r in self.rules if r.name in names])

    def expression(self) -> str:
        """All violations of a row: array<struct<rule_ord, rule, message, node_ids>>."""
        each = (f"transform({guarded(r.fires) if r.name != 'dag_structure' else r.fires}, v -> struct({r.order} AS rule_ord, '{r.name}' AS rule, v.message AS message, v.node_ids AS node_ids))" for r in self.rules)
        return f"concat({', '.join(each)})"


def verified(graphs: DataFrame, registry: RuleRegistry | None = None) -> DataFrame:
    """Nested graphs -> (recipe_id, dish_name, category, failure_code, is_valid, violations), a row per recipe.

    failure_code: dag_construction_error if an ingredient or operation node lacks what it needs, else edge_reference_error
    if an edge has an end without node, else null. The rules see the edges that have both ends. A recipe with a
    failure_code isn't valid.
    """
    missing = "exists(nodes, x -> x.node_type IS NULL OR x.node_type = 'ingredient' AND x.name IS NULL OR x.node_type = 'operation' AND x.op_type IS NULL)"
    code = f"CASE WHEN {missing} THEN 'dag_construction_error' WHEN n_broken_edges > 0 THEN 'edge_reference_error' END"
    rows = analysed(graphs, for_rules=True).withColumn("violations", F.expr((registry or RuleRegistry()).expression())).withColumn("failure_code", F.expr(code))
    return rows.select("recipe_id", "dish_name", "category", "failure_code", F.expr("failure_code IS NULL AND size(violations) = 0").alias("is_valid"), "violations")


def violations(verdicts: DataFrame) -> DataFrame:
    """(recipe_id, rule_ord, rule, message, node_ids), one row per violation."""
    return exploded(verdicts, "violations", "v").select("recipe_id", "v.*")


def violation_text(rule, message, node_ids):
    nodes = F.coalesce(F.nullif(F.array_join(node_ids, ", "), F.lit("")), F.lit("—"))
    return F.concat(F.lit("["), rule, F.lit("] "), message, F.lit(" (nodes: "), nodes, F.lit(")"))


def verdict_texts(verdicts: DataFrame) -> DataFrame:
    """(recipe_id, text): the verdict in words, a line per violation in rule and node order."""
    lines = F.transform("violations", lambda v: F.concat(F.lit("  · "), violation_text(v["rule"], v["message"], v["node_ids"])))
    bad = F.array_join(F.concat(F.array(F.concat(F.lit("✗ Recipe has "), F.size("violations").cast("string"), F.lit(" violation(s):"))), lines), "\n")
    return verdicts.select("recipe_id", F.when(F.size("violations") == 0, "✓ Recipe is valid (no constraint violations)").otherwise(bad).alias("text"))


def table_verdicts(spark, sf_dir: str) -> DataFrame:
    return verified(nested(*long_form(spark, sf_dir, spread=True)))
