"""Queries on the recipe corpus and the vocabulary, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potflow.operators import vocabulary
from potflow.operators.graphs import long_form
from potflow.plans.graph_sql import GRAPHS, INGREDIENTS, OPERATIONS
from potflow.sources.json_io import graphs_from_json, graphs_to_json, sampled
from potflow.sources.replay import prompt_hash, replayed
from potflow.sources.tables import current, key, table


def partition(spark, sf_dir: str) -> DataFrame:
    """Current recipes of one partition, however it is written."""
    rows = current(table(spark, sf_dir, "layer1").select("id", "partition", "title", "loaded_at"))
    return rows.where(F.lower(F.trim("partition")) == "test").select("id", "title")


def sample(spark, sf_dir: str) -> DataFrame:
    """Exactly 200 current recipes."""
    return sampled(current(table(spark, sf_dir, "layer1").select("id", "loaded_at")).select("id"), 200)


def records(spark, sf_dir: str) -> DataFrame:
    """Current recipes as the parser gets them: absent texts empty, absent lists without entries."""
    none = F.array().cast("array<string>")
    texts = lambda c: F.filter(F.coalesce(F.col(f"{c}.text"), none), lambda x: x.isNotNull())
    return current(table(spark, sf_dir, "layer1")).select("id", F.coalesce("title", F.lit("")).alias("title"), texts("ingredients").alias("ingredients"), texts("instructions").alias("instructions"))


def prompts(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("id").alias("recipe_id"), vocabulary.user_prompt(F.col("title"), F.col("ingredients"), F.col("instructions")).alias("prompt"))


def replay(spark, sf_dir: str) -> DataFrame:
    """Recorded responses by prompt hash, for the hashes that the responses' own recipes were asked with."""
    responses = table(spark, sf_dir, "responses")
    asked = responses.where("recipe_id IS NOT NULL").select(key("recipe_id").alias("recipe_id"), "prompt_hash").distinct()
    return replayed(asked, responses)


def derived_vocabulary(spark, sf_dir: str) -> DataFrame:
    """All typed ingredient names as a vocabulary; of names with one key the least text stays."""
    names = table(spark, sf_dir, "det_ingrs").select(F.explode("ingredients.text").alias("name")).where("name IS NOT NULL").distinct()
    ranked = names.groupBy(F.lower(F.replace("name", F.lit(" "), F.lit("_")))).agg(F.min("name").alias("name"))
    return vocabulary.classified(ranked.select("name", F.lit(None).cast("string").alias("verb"), F.lit(0).alias("pos")))


def round_trip(spark, sf_dir: str) -> DataFrame:
    """Graphs written as JSON and read again: all nodes of the graphs that can be read, with their payloads."""
    nodes = graphs_from_json(graph_json(spark, sf_dir))[1]
    return nodes.select("recipe_id", "node_seq", "node_id", "node_type", "ingredient.*", "operation.*")


def round_trip_edges(spark, sf_dir: str) -> DataFrame:
    return graphs_from_json(graph_json(spark, sf_dir))[2]


def read_errors(spark, sf_dir: str) -> DataFrame:
    """Graphs that are written but not read again, as they lack what a graph needs."""
    return graphs_from_json(graph_json(spark, sf_dir))[3]


def graph_json(spark, sf_dir: str) -> DataFrame:
    return graphs_to_json(*long_form(spark, sf_dir, spread=True))


def looked_up(spark, sf_dir: str) -> DataFrame:
    """Keys of the test vocabulary looked up in the built-in one."""
    keys = table(spark, sf_dir, "dim_ingredient").select("vocab_key")
    return vocabulary.looked_up(keys.unionByName(vocabulary.dim_ingredient(spark).select("vocab_key")).distinct(), vocabulary.dim_ingredient(spark))


QUERIES: dict[str, Callable] = {
    "corpus_partition": partition,
    "corpus_sample": sample,
    "corpus_records": lambda s, d: records(s, d).select("id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.size("instructions").alias("n_instructions")),
    "user_prompts": prompts,
    "prompt_hashes": lambda s, d: prompts(s, d).select("recipe_id", prompt_hash(F.col("prompt")).alias("prompt_hash")),
    "replayed_responses": replay,
    "vocabulary_block": lambda s, d: vocabulary.vocabulary_block(vocabulary.dim_ingredient(s), vocabulary.dim_operation(s)),
    "derived_vocabulary": derived_vocabulary,
    "ingredient_lookup": looked_up,
    "graph_json": graph_json,
    "json_round_trip": round_trip,
    "json_round_trip_edges": round_trip_edges,
    "json_read_errors": read_errors,
    "system_prompt": lambda s, d: vocabulary.system_prompt(vocabulary.dim_ingredient(s), vocabulary.dim_operation(s)),
}
_NOW = """SELECT lower(trim(id, ' ')) AS id, * EXCLUDE (id) FROM layer1 WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id, ' ')) ORDER BY loaded_at DESC, removed_at DESC NULLS LAST) = 1"""
_LIST = "coalesce([x.text FOR x IN {0} IF x.text IS NOT NULL], [])"
_PROMPT = f"""SELECT id AS recipe_id, 'TITLE: ' || coalesce(title, '') || E'\\n\\nINGREDIENTS:\\n' || coalesce(array_to_string(['  - ' || x FOR x IN {_LIST.format("ingredients")}], chr(10)), '') ||
  E'\\n\\nINSTRUCTIONS:\\n' || coalesce(array_to_string(['  ' || i || '. ' || x FOR x, i IN {_LIST.format("instructions")}], chr(10)), '') AS prompt FROM ({_NOW})"""
_BLOCK = f"""E'ALLOWED INGREDIENTS (use exact key names):\\n' || (SELECT string_agg(l, chr(10) ORDER BY l) FROM (SELECT '  ' || upper(category) || ': ' || string_agg(vocab_key, ', ' ORDER BY vocab_key) AS l FROM {INGREDIENTS} GROUP BY category)) ||
  E'\\n\\nALLOWED OPERATIONS (use exact values):\\n' || (SELECT string_agg(l, chr(10) ORDER BY l) FROM (SELECT '  ' || upper(grp) || ': ' || string_agg(op_type, ', ' ORDER BY op_type) AS l FROM {OPERATIONS} GROUP BY grp)) ||
  E'\\n\\nALLOWED CATEGORIES: {", ".join(vocabulary.DISH_CATEGORIES)}'"""
_INSTRUCTIONS = (vocabulary.INSTRUCTIONS % ("|".join(vocabulary.DISH_CATEGORIES), "|".join(sorted(vocabulary.CATEGORIES)))).replace("'", "''")
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_ANY = lambda f, xs: "(" + " OR ".join(f"{f}(lower(name), '{x}')" for x in xs) + ")"
_WRITTEN = f""", shown AS (SELECT n.* REPLACE (CASE WHEN json_valid(n.params) THEN json(n.params) ELSE '{{}}' END AS params) FROM n),
pairs AS (SELECT recipe_id, src, dst, row_number() OVER (PARTITION BY recipe_id ORDER BY f, edge_seq) - 1 AS place FROM (SELECT *, min(edge_seq) OVER (PARTITION BY recipe_id, src) AS f FROM e)),
objects AS (SELECT recipe_id, string_agg('{{"node_id":' || to_json(node_id) || ',"node_type":' || coalesce(to_json(node_type), 'null') ||
    CASE WHEN node_type = 'ingredient' THEN ',"ingredient":{{"name":' || coalesce(to_json(name), 'null') || ',"category":' || coalesce(to_json(category), 'null') || ',"is_protein":' || to_json(is_protein) || ',"is_liquid":' || to_json(is_liquid) || '}}' ELSE '' END ||
    CASE WHEN node_type = 'operation' THEN ',"operation":{{"op_type":' || coalesce(to_json(op_type), 'null') || ',"params":' || params || '}}' ELSE '' END || '}}', ',' ORDER BY pos) AS t FROM shown GROUP BY recipe_id),
links AS (SELECT recipe_id, string_agg('[' || coalesce(to_json(src), 'null') || ',' || coalesce(to_json(dst), 'null') || ']', ',' ORDER BY place) AS t FROM pairs GROUP BY recipe_id),
texts AS (SELECT r.recipe_id, '{{"dish_name":' || coalesce(to_json(dish_name), 'null') || ',"category":' || coalesce(to_json(category), 'null') || ',"nodes":[' || coalesce(objects.t, '') || '],"edges":[' || coalesce(links.t, '') || ']}}' AS json
  FROM r LEFT JOIN objects USING (recipe_id) LEFT JOIN links USING (recipe_id)),
faults AS (SELECT recipe_id, CASE WHEN coalesce(category NOT IN {_IN(vocabulary.DISH_CATEGORIES)}, true) THEN 'category ' || coalesce(category, 'null')
    WHEN EXISTS (SELECT 1 FROM shown WHERE shown.recipe_id = r.recipe_id AND coalesce(node_type NOT IN {_IN(vocabulary.NODE_TYPES)}, true)) THEN 'unknown node_type'
    WHEN EXISTS (SELECT 1 FROM shown WHERE shown.recipe_id = r.recipe_id AND node_type = 'ingredient' AND (name IS NULL OR coalesce(shown.category NOT IN {_IN(vocabulary.CATEGORIES)}, true))) THEN 'ingredient without name or with an unknown category'
    WHEN EXISTS (SELECT 1 FROM shown WHERE shown.recipe_id = r.recipe_id AND node_type = 'operation' AND coalesce(op_type NOT IN (SELECT op_type FROM op), true)) THEN 'unknown op_type' END AS fault FROM r)
"""
SQL = {
    "corpus_partition": f"SELECT id, title FROM ({_NOW}) WHERE lower(trim(partition, ' ')) = 'test'",
    "corpus_sample": "SELECT id FROM (SELECT DISTINCT lower(trim(id, ' ')) AS id FROM layer1 WHERE id IS NOT NULL) ORDER BY md5(id || '42'), id LIMIT 200",
    "corpus_records": f"SELECT id, coalesce(title, '') AS title, coalesce(array_to_string({_LIST.format('ingredients')}, '|'), '') AS ingredients, len({_LIST.format('instructions')}) AS n_instructions FROM ({_NOW})",
    "user_prompts": _PROMPT,
    "prompt_hashes": f"SELECT recipe_id, substr(sha256(prompt), 1, 16) AS prompt_hash FROM ({_PROMPT})",
    "replayed_responses": """SELECT recipe_id, prompt_hash, raw FROM (SELECT DISTINCT lower(trim(recipe_id, ' ')) AS recipe_id, prompt_hash FROM responses WHERE recipe_id IS NOT NULL)
  LEFT JOIN (SELECT prompt_hash, raw FROM responses WHERE raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt_hash ORDER BY received_at DESC NULLS LAST, attempt DESC NULLS LAST, raw DESC) = 1) USING (prompt_hash)""",
    "vocabulary_block": f"SELECT {_BLOCK} AS block",
    "system_prompt": f"SELECT {_BLOCK} || chr(10) || '{_INSTRUCTIONS}' AS prompt",
    "derived_vocabulary": f"""SELECT vocab_key, replace(name, '_', ' ') AS name, CASE WHEN is_protein THEN 'protein' WHEN is_liquid THEN 'liquid' WHEN vocab_key IN {_IN(vocabulary.SEASONING_KEYS)} THEN 'seasoning'
    WHEN {_ANY("contains", vocabulary.ALLIUM_PARTS)} THEN 'allium' ELSE 'vegetable' END AS category, is_protein, is_liquid FROM (
  SELECT *, {_ANY("contains", vocabulary.PROTEIN_PARTS)} AS is_protein, {_ANY("ends_with", vocabulary.LIQUID_ENDS)} AS is_liquid FROM (
  SELECT lower(replace(name, ' ', '_')) AS vocab_key, min(name) AS name FROM (SELECT unnest(ingredients).text AS name FROM det_ingrs) WHERE name <> '' GROUP BY 1))""",
    "ingredient_lookup": f"""SELECT vocab_key, coalesce(name, replace(vocab_key, '_', ' ')) AS name, coalesce(category, 'vegetable') AS category, coalesce(is_protein, false) AS is_protein, coalesce(is_liquid, false) AS is_liquid
  FROM (SELECT vocab_key FROM dim_ingredient UNION SELECT vocab_key FROM {INGREDIENTS}) LEFT JOIN (SELECT * FROM {INGREDIENTS}) USING (vocab_key)""",
    "graph_json": GRAPHS + _WRITTEN + "SELECT recipe_id, json FROM texts",
    "json_round_trip": GRAPHS + _WRITTEN + """SELECT recipe_id, row_number() OVER (PARTITION BY recipe_id ORDER BY pos) - 1 AS node_seq, node_id, node_type, CASE WHEN node_type = 'ingredient' THEN name END AS name,
    CASE WHEN node_type = 'ingredient' THEN category END AS category, CASE WHEN node_type = 'ingredient' THEN is_protein END AS is_protein, CASE WHEN node_type = 'ingredient' THEN is_liquid END AS is_liquid,
    CASE WHEN node_type = 'operation' THEN op_type END AS op_type, CASE WHEN node_type = 'operation' THEN params END AS params
  FROM shown WHERE recipe_id IN (SELECT recipe_id FROM faults WHERE fault IS NULL)""",
    "json_round_trip_edges": GRAPHS + _WRITTEN + "SELECT recipe_id, src, dst, place AS edge_seq FROM pairs WHERE recipe_id IN (SELECT recipe_id FROM faults WHERE fault IS NULL)",
    "json_read_errors": GRAPHS + _WRITTEN + "SELECT recipe_id, 'dag_construction_error' AS failure_code, fault AS failure_detail FROM faults WHERE fault IS NOT NULL",
}
