"""Process graphs in long and nested form, and operators on them.

Long form: recipes, nodes and edges as tables. Nested form: one row per recipe with its nodes in order and its edges as
pairs of node positions; fixpoints run batch by batch on these rows (see walks), so they need no shuffle and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potflow.operators.vocabulary import HEAT, group_of
from potflow.operators.walks import order_of, walked
from potflow.sources.tables import key, table

NODE = ("node_id", "node_type", "name", "category", "is_protein", "is_liquid", "op_type", "grp", "params")


def by_recipe(rows: DataFrame) -> DataFrame:
    """Rows shuffled by recipe_id into a fixed number of partitions, which later groupings and joins by recipe_id reuse.

    Graph rows are small and dear to evaluate; adaptive execution would put them into few partitions by their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recipe_id")


def recipes(raw: DataFrame, spread: bool = False) -> DataFrame:
    """(recipe_id, dish_name, category), one row per recipe: the latest by loaded_at. Rows without recipe_id are left out."""
    rows = raw.where("recipe_id IS NOT NULL").select(key("recipe_id").alias("recipe_id"), "dish_name", "category", "loaded_at")
    latest = F.max_by(F.struct("dish_name", "category"), F.struct("loaded_at", "dish_name", "category")).alias("r")
    return (by_recipe(rows) if spread else rows).groupBy("recipe_id").agg(latest).select("recipe_id", "r.dish_name", "r.category")


def nodes(raw: DataFrame, spread: bool = False) -> DataFrame:
    """(recipe_id, pos, node_id, node_type, name, category, is_protein, is_liquid, op_type, grp, params).

    Of rows with one node_id the last by node_seq gives the payload, the first the position. Rows without recipe_id or
    node_id are left out. Null flags are false; a null category stays null.
    """
    rows = raw.where("recipe_id IS NOT NULL AND node_id IS NOT NULL").select(
        key("recipe_id").alias("recipe_id"), key("node_id").alias("node_id"), "node_seq", "loaded_at", "node_type", "ingredient.name", "ingredient.category",
        F.coalesce("ingredient.is_protein", F.lit(False)).alias("is_protein"), F.coalesce("ingredient.is_liquid", F.lit(False)).alias("is_liquid"), "operation.op_type", "operation.params",
    )
    payload = F.struct("node_type", "name", "category", "is_protein", "is_liquid", "op_type", "params")
    one = (by_recipe(rows) if spread else rows).groupBy("recipe_id", "node_id").agg(F.min("node_seq").alias("pos"), F.max_by(payload, F.struct("node_seq", "loaded_at", payload)).alias("p"))
    return one.select("recipe_id", "pos", "node_id", "p.*").withColumn("grp", group_of(F.col("op_type")))


def edges(raw: DataFrame, spread: bool = False) -> DataFrame:
    """(recipe_id, src, dst, edge_seq): copies of a row count once, edges that are there several times stay."""
    rows = raw.where("recipe_id IS NOT NULL").select(key("recipe_id").alias("recipe_id"), key("src").alias("src"), key("dst").alias("dst"), "edge_seq")
    return (by_recipe(rows) if spread else rows).distinct()


def long_form(spark, sf_dir: str, spread: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables. With ``spread`` they are shuffled by recipe_id first, for work on whole graphs: one shuffle each,
    as the groupings and joins that follow find their rows together."""
    return tuple(f(table(spark, sf_dir, name), spread) for f, name in ((recipes, "recipes"), (nodes, "nodes"), (edges, "edges")))


def nested(recipes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(recipe_id, dish_name, category, nodes, ids, n, edges, n_broken_edges), one row per recipe.

    nodes are in order; edges hold positions of nodes and are in order. Edges with an end that no node has are counted in
    n_broken_edges and left out. All three tables are shuffled once, by recipe_id.
    """
    ns = nodes.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("pos", *NODE))).alias("nodes"))
    es = edges.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("edge_seq", "src", "dst"))).alias("pairs"))
    rows = recipes.join(ns, "recipe_id", "left").join(es, "recipe_id", "left")
    return indexed(rows)


def indexed(rows: DataFrame) -> DataFrame:
    """rows(..., nodes, pairs array<struct<edge_seq, src, dst>>) with ids, n, edges and n_broken_edges instead of pairs."""
    kind = dict(rows.dtypes)["nodes"]
    rows = rows.withColumn("nodes", F.expr(f"coalesce(nodes, cast(array() AS {kind}))")).withColumn("ids", F.expr("transform(nodes, x -> x.node_id)"))
    rows = rows.withColumn("n", F.expr("size(nodes)")).withColumn(
        "found",
        F.expr("transform(coalesce(pairs, array()), e -> struct(cast(coalesce(array_position(ids, e.src), 0) - 1 AS int) AS s, cast(coalesce(array_position(ids, e.dst), 0) - 1 AS int) AS d, e.edge_seq AS q))"),
    )
    rows = rows.withColumn("edges", F.expr("filter(found, e -> e.s >= 0 AND e.d >= 0)"))
    return rows.withColumn("n_broken_edges", F.expr("size(found) - size(edges)")).drop("pairs", "found")


#: Whether all edges lead to later nodes: then there is no cycle.
FORWARD = "NOT exists(edges, e -> e.s >= e.d)"
#: Which nodes heat; the first output's position or -1; the plates.
HEATS = "transform(nodes, x -> coalesce(x.grp IN ('" + "', '".join(HEAT) + "'), false))"
OUTPUT = "cast(array_position(transform(nodes, x -> coalesce(x.node_type, '')), 'dish_output') - 1 AS int)"
PLATES = "CASE WHEN n = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(0, n - 1), i -> coalesce(nodes[i].op_type = 'plate' AND nodes[i].node_type = 'operation', false)) END"


def with_order(graphs: DataFrame) -> DataFrame:
    """Nested graphs with topo (positions in topological order) and levels (the longest way to each of these)."""
    return graphs.withColumn("order", order_of("n", "edges")).withColumns({"topo": F.col("order.topo"), "levels": F.col("order.levels")}).drop("order")


def analysed(graphs: DataFrame, for_rules: bool = False) -> DataFrame:
    """Nested graphs with forward, cyclic, heats, output, unheated and after_plates. For rules, unheated is left empty
    where no ingredient is a protein."""
    for name, expression in (("forward", FORWARD), ("heats", HEATS), ("output", OUTPUT), ("plates", PLATES)):
        graphs = graphs.withColumn(name, F.expr(expression))
    wanted = F.expr("CASE WHEN exists(nodes, x -> x.is_protein) THEN output ELSE -1 END") if for_rules else F.col("output")
    walks = walked("n", "edges", "forward", "heats", wanted, "plates")
    return graphs.withColumn("walks", walks).withColumns({c: F.col(f"walks.{c}") for c in ("cyclic", "unheated", "after_plates")}).drop("walks", "plates")


def exploded(rows: DataFrame, array: str, element: str) -> DataFrame:
    """A row per element. From a plain explode the optimizer infers a filter on the array's size and pushes it below the
    projection that computes the array, which would then be computed twice."""
    return rows.withColumn(element, F.explode_outer(array)).where(F.col(element).isNotNull())


def topological(graphs: DataFrame) -> DataFrame:
    """(recipe_id, node_id, rank) from 0; recipes with a cycle give only the nodes before it."""
    ranked = with_order(graphs).select("recipe_id", "ids", F.posexplode_outer("topo").alias("rank", "i"))
    return ranked.where("i IS NOT NULL").select("recipe_id", F.expr("ids[i]").alias("node_id"), "rank")


def cyclic(graphs: DataFrame) -> DataFrame:
    """(recipe_id, n_stuck): recipes with a cycle and how many nodes stand on or behind one."""
    rows = with_order(graphs).select("recipe_id", F.expr("CASE WHEN size(topo) < n THEN array(n - size(topo)) END").alias("stuck"))
    return exploded(rows, "stuck", "n_stuck").drop("stuck")


def neighbours(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """(recipe_id, node_id, edge_seq, neighbour): successors (end src) or predecessors (end dst), one row per edge."""
    other = "dst" if end == "src" else "src"
    known = nodes.select("recipe_id", F.col("node_id").alias(other))
    own = nodes.select("recipe_id", F.col("node_id").alias(end))
    return edges.join(own, ["recipe_id", end]).join(known, ["recipe_id", other]).select("recipe_id", F.col(end).alias("node_id"), "edge_seq", F.col(other).alias("neighbour"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(recipe_id, node_id, n_in, n_out) of every node, counting edge rows."""
    ends = [edges.select("recipe_id", F.col(c).alias("node_id"), F.lit(c == "dst").cast("int").alias("i"), F.lit(c == "src").cast("int").alias("o")) for c in ("src", "dst")]
    rows = nodes.select("recipe_id", "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("own"))
    both = rows.unionByName(ends[0].unionByName(ends[1]).withColumn("own", F.lit(0)))
    sums = both.groupBy("recipe_id", "node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("own").alias("own"))
    return sums.where("own = 1").drop("own")


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that their recipe has no node for: (recipe_id, edge_seq, src, dst)."""
    known = nodes.select("recipe_id", "node_id")
    bad = [edges.join(known.withColumnRenamed("node_id", end), ["recipe_id", end], "left_anti").select("recipe_id", "edge_seq", "src", "dst") for end in ("src", "dst")]
    return bad[0].unionByName(bad[1]).distinct()


LABEL = "CASE node_type WHEN 'ingredient' THEN name WHEN 'operation' THEN op_type ELSE 'DISH' END"


def first_outputs(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'dish_output'").groupBy("recipe_id").agg(F.min_by("node_id", "pos").alias("node_id"))


def listed(nodes: DataFrame) -> DataFrame:
    """(recipe_id, ingredient_names, operation_types) in node order, comma-separated."""
    of = lambda kind, column: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("node_type") == kind, F.struct("pos", column)))), lambda x: x[column]), ",")
    return nodes.groupBy("recipe_id").agg(of("ingredient", "name").alias("ingredient_names"), of("operation", "op_type").alias("operation_types"))


def summaries(recipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(recipe_id, summary): dish, category and numbers of nodes; recipes without nodes have none of either kind."""
    counts = nodes.groupBy("recipe_id").agg(*(F.count_if(F.col("node_type") == k).alias(k) for k in ("ingredient", "operation")))
    text = "concat(\"RecipeDAG(dish='\", coalesce(dish_name, 'None'), \"', category=\", coalesce(category, 'None'), ', ingredients=', coalesce(ingredient, 0), ', operations=', coalesce(operation, 0), ')')"
    return recipes.join(counts, "recipe_id", "left").select("recipe_id", F.expr(text).alias("summary"))


def texts(graphs: DataFrame) -> DataFrame:
    """(recipe_id, text): the graph in words, operations in topological order, inputs in the order of their edges.

    A recipe with a cycle has a null text; so has one with an operation outside the vocabulary.
    """
    label = "transform(nodes, x -> CASE x.node_type WHEN 'ingredient' THEN coalesce(x.name, 'None') WHEN 'operation' THEN x.op_type ELSE 'DISH' END)"
    rows = with_order(graphs).withColumn("labels", F.expr(label))
    steps = "transform(filter(topo, i -> nodes[i].node_type = 'operation'), i -> concat(labels[i], ' ', coalesce(nullif(array_join(transform(filter(edges, e -> e.d = i), e -> labels[e.s]), ' and '), ''), 'ingredients')))"
    text = f"""
      CASE WHEN size(topo) = n AND NOT exists(nodes, x -> x.node_type = 'operation' AND x.grp IS NULL) THEN
        concat('A dish of ', coalesce(dish_name, 'None'), '. Ingredients: ', array_join(transform(filter(nodes, x -> x.node_type = 'ingredient'), x -> coalesce(x.name, 'None')), ', '),
          '. Preparation: ', coalesce(nullif(array_join({steps}, '; '), ''), 'combine all ingredients'), '.') END"""
    return rows.select("recipe_id", F.expr(text).alias("text"))


def transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(op_src, op_dst, n): how often one operation feeds another, over all graphs."""
    ops = nodes.where("node_type = 'operation'").select("recipe_id", "node_id", "op_type")
    pairs = edges.join(ops.toDF("recipe_id", "src", "op_src"), ["recipe_id", "src"]).join(ops.toDF("recipe_id", "dst", "op_dst"), ["recipe_id", "dst"])
    return pairs.groupBy("op_src", "op_dst").agg(F.count("*").alias("n"))


def edges_as_written(edges: DataFrame) -> DataFrame:
    """(recipe_id, src, dst, place): edges in the order of serialisation, grouped by source as first met."""
    first = F.min("edge_seq").over(Window.partitionBy("recipe_id", "src"))
    place = F.row_number().over(Window.partitionBy("recipe_id").orderBy("_first", "edge_seq")) - 1
    return edges.withColumn("_first", first).select("recipe_id", "src", "dst", place.alias("place"))
