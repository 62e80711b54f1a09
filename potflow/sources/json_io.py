"""JSON sources and sinks: corpora, vocabularies, graphs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potflow.operators.graphs import edges_as_written
from potflow.operators.vocabulary import CATEGORIES, DISH_CATEGORIES, GROUP_OF, NODE_TYPES, classified

CORPUS = "id string, partition string, title string, ingredients array<struct<text: string>>, instructions array<struct<text: string>>"
GRAPH = (
    "dish_name string, category string, nodes array<struct<node_id: string, node_type: string, ingredient: struct<name: string, category: string, is_protein: boolean, "
    "is_liquid: boolean>, operation: struct<op_type: string, params: %s>>>, edges array<array<string>>"
)
MEMBERS = ("dish_name", "category", "nodes", "edges")
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def read_corpus(spark: SparkSession, path: str, partition: str | None = None) -> DataFrame:
    """A corpus file, one JSON array of records. A missing path is an error. One array can't be split among tasks;
    rewrite it with store_corpus once."""
    rows = spark.read.schema(CORPUS).json(path, multiLine=True)
    return rows if partition is None else rows.where(F.col("partition") == partition)


def store_corpus(corpus: DataFrame, path: str) -> None:
    """The corpus as Parquet by partition, so that a partition filter reads only its files."""
    corpus.write.mode("overwrite").partitionBy("partition").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file, a JSON array of objects with name or verb, classified. Order in the file decides among equal keys."""
    rows = spark.read.schema("name string, verb string").json(path, multiLine=True)
    return classified(rows.withColumn("pos", F.monotonically_increasing_id()))


def sampled(corpus: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all if there are fewer), the same ones for a seed on any cluster and in any engine: those whose id
    and seed have the least MD5, equal ones by id."""
    return corpus.orderBy(F.md5(F.concat("id", F.lit(str(seed)))), "id").limit(n)


def fault(g: str = "g", keys: str = "keys") -> str:
    """What keeps a parsed graph from being built, null if nothing: SQL over the parsed object and its keys."""
    words = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    lacks = f"array_except(array{words(MEMBERS)}, {keys})"
    unlike = lambda test: f"exists({g}.nodes, x -> {test})"
    return f"""CASE
      WHEN {keys} IS NULL OR {g} IS NULL THEN 'no JSON object'
      WHEN size({lacks}) > 0 THEN concat('lacks ', array_join({lacks}, ', '))
      WHEN {g}.category IS NULL OR {g}.category NOT IN {words(DISH_CATEGORIES)} THEN concat('category ', coalesce({g}.category, 'null'))
      WHEN {g}.nodes IS NULL OR {unlike("x IS NULL OR x.node_id IS NULL")} THEN 'nodes without node_id'
      WHEN {unlike(f"x.node_type IS NULL OR x.node_type NOT IN {words(NODE_TYPES)}")} THEN 'unknown node_type'
      WHEN {unlike("x.node_type = 'ingredient' AND x.ingredient IS NULL OR x.node_type = 'operation' AND x.operation IS NULL")} THEN 'node without payload'
      WHEN {unlike(f"x.ingredient IS NOT NULL AND (x.ingredient.name IS NULL OR x.ingredient.category IS NULL OR x.ingredient.category NOT IN {words(CATEGORIES)})")} THEN 'ingredient without name or with an unknown category'
      WHEN {unlike(f"x.operation IS NOT NULL AND (x.operation.op_type IS NULL OR x.operation.op_type NOT IN {words(GROUP_OF)})")} THEN 'unknown op_type'
      WHEN {g}.edges IS NULL OR exists({g}.edges, e -> e IS NULL OR size(e) != 2) THEN 'edges that are no pairs' END"""


def graphs_from_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows(recipe_id, json) -> (recipes, nodes, edges, errors). Only whole graphs give recipes, nodes and edges; a node that
    comes again replaces the earlier one and keeps its place. errors(recipe_id, failure_code, failure_detail) has the others:
    json_parse_error for what is no JSON object, dag_construction_error for absent members, unknown categories, node or
    operation types, absent payloads and edges that are no pairs. Members of operations are kept as JSON text."""
    read = rows.select("recipe_id", F.from_json(column, GRAPH % "string", _STRICT).alias("g"), F.json_object_keys(column).alias("keys")).withColumn("failure_detail", F.expr(fault()))
    good = read.where("failure_detail IS NULL").select("recipe_id", "g.*")
    last = "transform(filter(nodes, (x, i) -> i = array_position(transform(nodes, y -> y.node_id), x.node_id) - 1), x -> element_at(filter(nodes, y -> y.node_id = x.node_id), -1))"
    twice = F.expr("size(array_distinct(transform(nodes, x -> x.node_id))) < size(nodes)")
    nodes = good.withColumn("nodes", F.when(twice, F.expr(last)).otherwise(F.col("nodes"))).select("recipe_id", F.posexplode("nodes").alias("node_seq", "x"))
    nodes = nodes.select("recipe_id", "node_seq", "x.node_id", "x.node_type", "x.ingredient", "x.operation")
    edges = good.select("recipe_id", F.posexplode("edges").alias("edge_seq", "x")).select("recipe_id", F.col("x")[0].alias("src"), F.col("x")[1].alias("dst"), "edge_seq")
    code = F.when(F.col("failure_detail") == "no JSON object", "json_parse_error").otherwise("dag_construction_error")
    errors = read.where("failure_detail IS NOT NULL").select("recipe_id", code.alias("failure_code"), "failure_detail")
    return good.select("recipe_id", "dish_name", "category"), nodes, edges, errors


def _quoted(column: str) -> Column:
    """A text, number or flag as JSON, null as null."""
    return F.expr(f"substring(to_json(array({column}), map('ignoreNullFields', 'false')), 2, length(to_json(array({column}), map('ignoreNullFields', 'false'))) - 2)")


def _object(*members: tuple[str, Column]) -> Column:
    """An object in JSON; members that are null columns are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), value) for name, value in members)), F.lit("}"))


def graphs_to_json(recipes: DataFrame, nodes: DataFrame, edges: DataFrame, indent: bool = False) -> DataFrame:
    """(recipe_id, json): graphs in the long form as JSON, nodes in order, edges grouped by source as first met.

    Members of operations are written as the JSON they are, without spaces; text that isn't JSON becomes {}. With
    ``indent`` the JSON is spread over lines.
    """
    as_json = F.from_json(F.concat(F.lit('{"p":'), "params", F.lit("}")), "p string", _STRICT)["p"]
    params = F.coalesce(F.when(F.ltrim("params").startswith('"') & as_json.isNotNull(), F.trim("params")).otherwise(as_json), F.lit("{}"))
    ingredient = _object(*((c, _quoted(c)) for c in ("name", "category", "is_protein", "is_liquid")))
    operation = _object(("op_type", _quoted("op_type")), ("params", params))
    only = lambda kind, value: F.when(F.col("node_type") == kind, value)
    node = _object(("node_id", _quoted("node_id")), ("node_type", _quoted("node_type")), ("ingredient", only("ingredient", ingredient)), ("operation", only("operation", operation)))
    ordered = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "t"))), lambda x: x["t"]), ",")
    ns = nodes.withColumn("t", node).groupBy("recipe_id").agg(ordered("pos").alias("ns"))
    es = edges_as_written(edges).withColumn("t", F.to_json(F.array("src", "dst"), {"ignoreNullFields": "false"})).groupBy("recipe_id").agg(ordered("place").alias("es"))
    listed = lambda c: F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("]"))
    whole = _object(("dish_name", _quoted("dish_name")), ("category", _quoted("category")), ("nodes", listed("ns")), ("edges", listed("es")))
    rows = recipes.join(ns, "recipe_id", "left").join(es, "recipe_id", "left").select("recipe_id", whole.alias("json"))
    return rows.withColumn("json", F.to_json(F.from_json("json", GRAPH % "variant", _STRICT), {"pretty": "true"})) if indent else rows


def write_results(results: DataFrame, path: str, form: str = "json") -> None:
    """Results as JSON or Parquet; the folder is made, what was there is replaced."""
    results.write.mode("overwrite").format(form).save(path)
