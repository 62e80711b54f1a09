"""Process graphs derived from lineitem by whole-number arithmetic, with faults of every kind built in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators.graphs import indexed
from potflow.operators.vocabulary import ingredient_rows, operation_rows
from potflow.sources.tables import table

_OUT = "rid % 97 != 0"


def graphs(spark, sf_dir: str) -> DataFrame:
    """The derived graphs in the nested form of operators.graphs. An order's lines come together in one shuffle; its nodes
    and edges are made from them in the row, with positions in the vocabularies from literal arrays."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    together = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy(F.col("l_orderkey").alias("rid"))
    orders = together.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), "l_extendedprice", "q"))).alias("ls"))
    text = lambda rows: ", ".join("struct(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    ingredients, operations = f"array({text([r[1:5] for r in ingredient_rows()])})", f"array({text([r[:2] for r in operation_rows()])})"

    def node(name: str, pos: str, kind: str, ingredient: str | None = None, operation: str | None = None) -> str:
        of = lambda struct, k, kind: f"{struct}.col{k}" if struct else "false" if kind == "boolean" else f"cast(NULL AS {kind})"
        fields = [("name", 1, "string"), ("category", 2, "string"), ("is_protein", 3, "boolean"), ("is_liquid", 4, "boolean")]
        own = ", ".join([*(f"'{f}', {of(ingredient, k, t)}" for f, k, t in fields), f"'op_type', {of(operation, 1, 'string')}", f"'grp', {of(operation, 2, 'string')}", "'params', cast(NULL AS string)"])
        return f"named_struct('pos', cast({pos} AS int), 'node_id', {name}, 'node_type', '{kind}', {own})"

    at = lambda array, place: f"{array}[cast({place} AS int)]"
    edge = lambda src, dst, seq: f"named_struct('edge_seq', cast({seq} AS int), 'src', {src}, 'dst', {dst})"
    nodes = f"""concat(
      flatten(transform(ls, (l, k) -> array_compact(array(
        {node("concat('i', k + 1)", "3 * (k + 1)", "ingredient", at(ingredients, "l.pk % 60"))},
        CASE WHEN l.q % 3 != 0 THEN {node("concat('j', k + 1)", "3 * (k + 1) + 1", "ingredient", at(ingredients, "(l.pk + 7 * l.sk) % 60"))} END,
        {node("concat('o', k + 1)", "3 * (k + 1) + 2", "operation", None, at(operations, "(l.sk + 3 * (k + 1)) % 32"))})))),
      array_compact(array(CASE WHEN {_OUT} THEN {node("'out'", "1000", "dish_output")} END, CASE WHEN rid % 89 = 0 THEN {node("'out2'", "1001", "dish_output")} END)))"""
    last = "concat('o', size(ls))"
    edges = f"""concat(
      flatten(transform(ls, (l, k) -> array_compact(array(
        CASE WHEN l.q != 13 THEN {edge("concat('i', k + 1)", "concat('o', k + 1)", "3 * (k + 1)")} END,
        CASE WHEN l.q % 3 != 0 THEN {edge("concat('j', k + 1)", "concat('o', k + 1)", "3 * (k + 1) + 1")} END,
        CASE WHEN k + 1 < size(ls) AND l.q % 19 != 0 THEN {edge("concat('o', k + 1)", "concat('o', k + 2)", "3 * (k + 1) + 2")} END)))),
      array_compact(array(CASE WHEN {_OUT} THEN {edge(last, "'out'", "1000")} END, CASE WHEN rid % 101 = 0 THEN {edge(last, "'o1'", "1001")} END,
        CASE WHEN rid % 83 = 0 AND {_OUT} THEN {edge("'out'", "'o1'", "1002")} END)))"""
    recipes = orders.select(
        F.col("rid").cast("string").alias("recipe_id"), F.concat(F.lit("Dish "), "rid").alias("dish_name"),
        F.expr("array('pasta', 'eggs', 'salad', 'stir_fry', 'soup')[cast(rid % 5 AS int)]").alias("category"), F.expr(nodes).alias("nodes"), F.expr(edges).alias("pairs"),
    )
    return indexed(recipes)


SQL = """WITH RECURSIVE
op AS (SELECT *, row_number() OVER () - 1 AS k FROM {operations}),
ing AS (SELECT *, row_number() OVER () - 1 AS k FROM {ingredients}),
lines AS (SELECT l_orderkey AS rid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
r AS (SELECT DISTINCT CAST(rid AS VARCHAR) AS recipe_id, 'Dish ' || rid AS dish_name, ['pasta', 'eggs', 'salad', 'stir_fry', 'soup'][rid % 5 + 1] AS category FROM lines),
n AS (
  SELECT CAST(rid AS VARCHAR) AS recipe_id, 'i' || pos AS node_id, 3 * pos AS pos, 'ingredient' AS node_type, name, category, is_protein, is_liquid, NULL AS op_type, NULL AS grp FROM lines JOIN ing ON k = pk % 60
  UNION ALL SELECT CAST(rid AS VARCHAR), 'j' || pos, 3 * pos + 1, 'ingredient', name, category, is_protein, is_liquid, NULL, NULL FROM lines JOIN ing ON k = (pk + 7 * sk) % 60 WHERE q % 3 <> 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'o' || pos, 3 * pos + 2, 'operation', NULL, NULL, false, false, op_type, grp FROM lines JOIN op ON k = (sk + 3 * pos) % 32
  UNION ALL SELECT CAST(rid AS VARCHAR), 'out', 1000, 'dish_output', NULL, NULL, false, false, NULL, NULL FROM lines WHERE pos = 1 AND rid % 97 <> 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'out2', 1001, 'dish_output', NULL, NULL, false, false, NULL, NULL FROM lines WHERE pos = 1 AND rid % 89 = 0),
e AS (
  SELECT CAST(rid AS VARCHAR) AS recipe_id, 'i' || pos AS src, 'o' || pos AS dst, 3 * pos AS edge_seq FROM lines WHERE q <> 13
  UNION ALL SELECT CAST(rid AS VARCHAR), 'j' || pos, 'o' || pos, 3 * pos + 1 FROM lines WHERE q % 3 <> 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'o' || pos, 'o' || (pos + 1), 3 * pos + 2 FROM lines WHERE pos < n AND q % 19 <> 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'o' || n, 'out', 1000 FROM lines WHERE pos = n AND rid % 97 <> 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'o' || n, 'o1', 1001 FROM lines WHERE pos = n AND rid % 101 = 0
  UNION ALL SELECT CAST(rid AS VARCHAR), 'out', 'o1', 1002 FROM lines WHERE pos = 1 AND rid % 83 = 0 AND rid % 97 <> 0),
"""
