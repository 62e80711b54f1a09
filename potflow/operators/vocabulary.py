"""The vocabulary of processes: operations, ingredients, categories, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (operation, group, greatest number of inputs, 0 for any).
OPERATIONS = [
    ("chop", "prep", 1),
    ("slice", "prep", 1),
    ("dice", "prep", 1),
    ("mince", "prep", 1),
    ("peel", "prep", 1),
    ("grate", "prep", 1),
    ("drain", "prep", 1),
    ("rinse", "prep", 1),
    ("saute", "dry_heat", 5),
    ("fry", "dry_heat", 3),
    ("sear", "dry_heat", 2),
    ("roast", "dry_heat", 5),
    ("bake", "dry_heat", 5),
    ("grill", "dry_heat", 3),
    ("broil", "dry_heat", 3),
    ("toast", "dry_heat", 2),
    ("boil", "moist_heat", 3),
    ("simmer", "moist_heat", 5),
    ("steam", "moist_heat", 3),
    ("poach", "moist_heat", 2),
    ("braise", "moist_heat", 5),
    ("mix", "combine", 0),
    ("blend", "combine", 0),
    ("whisk", "combine", 0),
    ("fold", "combine", 0),
    ("toss", "combine", 0),
    ("stir", "combine", 0),
    ("combine", "combine", 0),
    ("season", "finish", 0),
    ("plate", "finish", 0),
    ("garnish", "finish", 0),
    ("rest", "finish", 1),
]
#: Group, whether it heats, least number of inputs.
OPERATION_GROUPS = {
    "prep": (False, 1),
    "dry_heat": (True, 1),
    "moist_heat": (True, 1),
    "combine": (False, 2),
    "finish": (False, 1),
}
#: Operations that cook in a liquid; the operation a group's name stands for.
IN_LIQUID = ("boil", "simmer", "braise", "poach")
GROUP_DEFAULTS = {"prep": "chop", "dry_heat": "saute", "moist_heat": "simmer", "combine": "mix", "finish": "plate"}
HEAT = ("dry_heat", "moist_heat")
DISH_CATEGORIES = ("pasta", "eggs", "salad", "stir_fry", "soup")
NODE_TYPES = ("ingredient", "operation", "dish_output")
#: The categories and the built-in ingredients: (name, category).
CATEGORIES = ("protein", "vegetable", "allium", "grain", "dairy", "fat", "seasoning", "liquid", "fruit")
INGREDIENTS = [
    ("chicken breast", "protein"),
    ("ground beef", "protein"),
    ("salmon", "protein"),
    ("eggs", "protein"),
    ("tofu", "protein"),
    ("shrimp", "protein"),
    ("bacon", "protein"),
    ("guanciale", "protein"),
    ("pancetta", "protein"),
    ("tomato", "vegetable"),
    ("spinach", "vegetable"),
    ("broccoli", "vegetable"),
    ("bell pepper", "vegetable"),
    ("mushroom", "vegetable"),
    ("carrot", "vegetable"),
    ("zucchini", "vegetable"),
    ("celery", "vegetable"),
    ("lettuce", "vegetable"),
    ("cucumber", "vegetable"),
    ("corn", "vegetable"),
    ("peas", "vegetable"),
    ("garlic", "allium"),
    ("onion", "allium"),
    ("shallot", "allium"),
    ("scallion", "allium"),
    ("spaghetti", "grain"),
    ("fettuccine", "grain"),
    ("penne", "grain"),
    ("rice", "grain"),
    ("flour", "grain"),
    ("breadcrumbs", "grain"),
    ("butter", "dairy"),
    ("parmesan", "dairy"),
    ("mozzarella", "dairy"),
    ("cream", "dairy"),
    ("milk", "dairy"),
    ("heavy cream", "dairy"),
    ("olive oil", "fat"),
    ("vegetable oil", "fat"),
    ("sesame oil", "fat"),
    ("salt", "seasoning"),
    ("black pepper", "seasoning"),
    ("cumin", "seasoning"),
    ("paprika", "seasoning"),
    ("oregano", "seasoning"),
    ("basil", "seasoning"),
    ("soy sauce", "seasoning"),
    ("chili flakes", "seasoning"),
    ("thyme", "seasoning"),
    ("rosemary", "seasoning"),
    ("water", "liquid"),
    ("chicken broth", "liquid"),
    ("vegetable broth", "liquid"),
    ("white wine", "liquid"),
    ("lemon juice", "liquid"),
    ("tomato sauce", "liquid"),
    ("vinegar", "liquid"),
    ("lemon", "fruit"),
    ("lime", "fruit"),
    ("cherry tomato", "fruit"),
]
LIQUID_NAMES = ("cream", "milk", "heavy cream", "soy sauce")
PUBLISHED_TOP = ("flour", "butter", "cream", "milk", "salt", "black pepper")
#: How names of a derived vocabulary are classified.
PROTEIN_PARTS = ("chicken", "beef", "pork", "fish", "egg", "tofu", "shrimp", "lamb", "turkey", "salmon", "tuna", "bacon", "ham", "sausage")
LIQUID_ENDS = ("juice", "sauce", "broth", "wine", "water", "oil", "milk", "cream")
SEASONING_KEYS = (
    "salt", "pepper", "cumin", "paprika", "oregano", "basil", "thyme", "rosemary", "garlic_powder", "onion_powder", "cinnamon", "nutmeg", "cayenne",
    "turmeric", "ginger", "soy_sauce", "vanilla",
)
ALLIUM_PARTS = ("onion", "garlic", "shallot", "scallion", "leek")


def operation_rows() -> list[tuple]:
    """(op_type, grp, requires_heat, requires_liquid_input, min_inputs, max_inputs, template)"""
    return [(name, group, OPERATION_GROUPS[group][0], name in IN_LIQUID, OPERATION_GROUPS[group][1], most, name + " {inputs}") for name, group, most in OPERATIONS]


def ingredient_rows() -> list[tuple]:
    """(vocab_key, name, category, is_protein, is_liquid, in_published_top16)"""
    rows = []
    for name, category in INGREDIENTS:
        liquid = category in ("fat", "liquid") or name in LIQUID_NAMES
        rows.append((name.replace(" ", "_"), name, category, category == "protein", liquid, name in PUBLISHED_TOP))
    return rows


GROUP_OF = {r[0]: r[1] for r in operation_rows()}


def dim_operation(spark: SparkSession) -> DataFrame:
    schema = "op_type string, grp string, requires_heat boolean, requires_liquid_input boolean, min_inputs int, max_inputs int, template string"
    return spark.createDataFrame(operation_rows(), schema)


def dim_ingredient(spark: SparkSession) -> DataFrame:
    schema = "vocab_key string, name string, category string, is_protein boolean, is_liquid boolean, in_published_top16 boolean"
    return spark.createDataFrame(ingredient_rows(), schema)


def group_of(op_type: Column) -> Column:
    """The group of an operation, null for an unknown one: a literal map, so no join."""
    pairs = [F.lit(x) for pair in GROUP_OF.items() for x in pair]
    return F.create_map(*pairs)[op_type]


def rewrite_groups(operations: DataFrame) -> DataFrame:
    """Each group with its operations in order."""
    return operations.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("op_type")), ",").alias("operations"))


def classified(names: DataFrame) -> DataFrame:
    """names(name, verb, pos) -> derived vocabulary (vocab_key, name, category, is_protein, is_liquid).

    name, else verb; empty ones are skipped. The flags don't depend on the category. Of equal keys the last by pos stays.
    """
    rows = names.select(F.coalesce(F.nullif("name", F.lit("")), F.col("verb")).alias("raw"), "pos").where("raw <> ''")
    low, vocab_key = F.lower("raw"), F.lower(F.replace("raw", F.lit(" "), F.lit("_")))
    any_of = lambda test, values: F.greatest(*(test(v) for v in values))
    protein, liquid = any_of(low.contains, PROTEIN_PARTS), any_of(low.endswith, LIQUID_ENDS)
    category = (
        F.when(protein, "protein").when(liquid, "liquid").when(vocab_key.isin(*SEASONING_KEYS), "seasoning")
        .when(any_of(low.contains, ALLIUM_PARTS), "allium").otherwise("vegetable")
    )
    rows = rows.select(vocab_key.alias("vocab_key"), F.replace("raw", F.lit("_"), F.lit(" ")).alias("name"), category.alias("category"), protein.alias("is_protein"), liquid.alias("is_liquid"), "pos")
    last = F.max_by(F.struct("name", "category", "is_protein", "is_liquid"), "pos").alias("v")
    return rows.groupBy("vocab_key").agg(last).select("vocab_key", "v.*")


def looked_up(keys: DataFrame, ingredients: DataFrame) -> DataFrame:
    """keys(vocab_key) with the vocabulary's entry, or a vegetable named after the key. Spark broadcasts a vocabulary that is
    small enough."""
    joined = keys.join(ingredients.select("vocab_key", "name", "category", "is_protein", "is_liquid"), "vocab_key", "left")
    return joined.select(
        "vocab_key", F.coalesce("name", F.replace("vocab_key", F.lit("_"), F.lit(" "))).alias("name"), F.coalesce("category", F.lit("vegetable")).alias("category"),
        F.coalesce("is_protein", F.lit(False)).alias("is_protein"), F.coalesce("is_liquid", F.lit(False)).alias("is_liquid"),
    )


def vocabulary_block(ingredients: DataFrame, operations: DataFrame) -> DataFrame:
    """One row (block): the vocabulary as a prompt lists it, both lists by upper-case group, sorted."""

    def lines(df: DataFrame, group: str, name: str) -> DataFrame:
        line = F.concat(F.lit("  "), F.upper(group), F.lit(": "), F.array_join(F.array_sort(F.collect_list(name)), ", "))
        return df.groupBy(group).agg(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))

    first, second = lines(ingredients, "category", "vocab_key").scalar(), lines(operations, "grp", "op_type").scalar()
    block = F.concat(
        F.lit("ALLOWED INGREDIENTS (use exact key names):\n"), first, F.lit("\n\nALLOWED OPERATIONS (use exact values):\n"), second,
        F.lit("\n\nALLOWED CATEGORIES: " + ", ".join(DISH_CATEGORIES)),
    )
    return ingredients.sparkSession.range(1).select(block.alias("block"))


#: Fixed value: what follows the vocabulary in a system prompt.
INSTRUCTIONS = """
Answer with one JSON object and nothing else, in this form:
{
  "dish_name": "...",
  "category": "%s|out_of_scope",
  "nodes": [
    {"node_id": "n0", "node_type": "ingredient", "ingredient": {"name": "...", "category": "%s", "is_protein": false, "is_liquid": false}},
    {"node_id": "n1", "node_type": "operation", "operation": {"op_type": "...", "params": {}}},
    {"node_id": "n2", "node_type": "dish_output"}
  ],
  "edges": [["n0", "n1"], ["n1", "n2"]]
}

RULES:
1. Give each ingredient as the nearest allowed key and leave out what has none near; if more than half of the main ones have none, the category is "out_of_scope".
2. Give each step as the nearest allowed operation.
3. Edges follow the order of the steps: an ingredient goes into the first operation that uses it, an operation into the next, and every path ends in dish_output.
4. Each ingredient has exactly one outgoing edge.
5. Each operation has one outgoing edge, the last one to dish_output.
6. There is exactly one dish_output, at the end.
7. An ingredient's name may be written with spaces; its category is one of those in the form, letter by letter.
8. A dish of another category than the allowed ones is "out_of_scope"; dish_output alone is enough then."""


def system_prompt(ingredients: DataFrame, operations: DataFrame) -> DataFrame:
    """One row (prompt): the vocabulary block, the form of the answer and the rules."""
    kinds = ingredients.select(F.array_join(F.array_sort(F.collect_set("category")), "|")).scalar()
    text = F.format_string(INSTRUCTIONS, F.lit("|".join(DISH_CATEGORIES)), kinds)
    return vocabulary_block(ingredients, operations).select(F.concat("block", F.lit("\n"), text).alias("prompt"))


def user_prompt(title: Column, ingredients: Column, instructions: Column) -> Column:
    """The text that asks for a recipe's graph: title, bullets, numbered steps."""
    bullets = F.array_join(F.transform(ingredients, lambda x: F.concat(F.lit("  - "), x)), "\n")
    steps = F.array_join(F.transform(instructions, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat(F.lit("TITLE: "), title, F.lit("\n\nINGREDIENTS:\n"), bullets, F.lit("\n\nINSTRUCTIONS:\n"), steps)
