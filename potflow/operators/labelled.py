"""Labelled process graphs to measure the rules on: for each rule graphs that break it, and graphs that break none.

The graphs are rows: CASES has the name, the rule that must fire ("none" for a control), the dish and its category;
STEPS has the nodes in order, an ingredient by its name, an operation by its type, the output as "dish"; FLOWS has the
edges in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from potflow.operators.vocabulary import GROUP_OF, ingredient_rows

#: (case, rule, dish, category)
CASES = [
    ("control/baked_salmon", "none", "Baked salmon", "eggs"),
    ("control/tomato_soup", "none", "Tomato soup", "soup"),
    ("control/cucumber_salad", "none", "Cucumber salad", "salad"),
    ("control/heated_twice", "none", "Bacon and peas", "stir_fry"),
    ("structure/no_output", "dag_structure", "Rice", "soup"),
    ("structure/two_outputs", "dag_structure", "Corn", "salad"),
    ("structure/circle", "dag_structure", "Milk rice", "soup"),
    ("structure/output_goes_on", "dag_structure", "Celery", "salad"),
    ("structure/forgotten_lime", "dag_structure", "Zucchini", "stir_fry"),
    ("raw/tofu_sliced_only", "raw_protein_before_plate", "Tofu plate", "salad"),
    ("raw/one_of_two_ways", "raw_protein_before_plate", "Shrimp two ways", "stir_fry"),
    ("raw/straight_to_dish", "raw_protein_before_plate", "Salmon", "salad"),
    ("blend/mushroom", "solid_before_blend", "Mushroom cream", "soup"),
    ("blend/spinach_among_liquids", "solid_before_blend", "Green drink", "soup"),
    ("blend/second_blend", "solid_before_blend", "Broccoli cream", "soup"),
    ("plate/roasted_afterwards", "no_heat_after_plate", "Scallions", "salad"),
    ("plate/two_steps_later", "no_heat_after_plate", "Peas", "stir_fry"),
    ("plate/two_plates", "no_heat_after_plate", "Onions", "salad"),
    ("liquid/dry_rice", "moist_heat_needs_liquid", "Dry rice", "soup"),
    ("liquid/poached_in_nothing", "moist_heat_needs_liquid", "Eggs", "eggs"),
    ("liquid/braise_without_inputs", "moist_heat_needs_liquid", "Nothing braised", "soup"),
    ("combine/tossed_alone", "combine_needs_multiple_inputs", "Lettuce", "salad"),
    ("combine/mixed_after_chopping", "combine_needs_multiple_inputs", "Cucumber", "salad"),
    ("combine/nothing_combined", "combine_needs_multiple_inputs", "Nothing", "salad"),
    ("dangling/grated_for_nobody", "no_dangling_outputs", "Fettuccine", "pasta"),
    ("dangling/last_step_open", "no_dangling_outputs", "Toast", "eggs"),
    ("season/only_spices", "season_needs_target", "Spice mix", "salad"),
    ("season/no_inputs", "season_needs_target", "Air", "salad"),
]

#: (case, node, what it is)
STEPS = [
    ("control/baked_salmon", "fish", "salmon"), ("control/baked_salmon", "sour", "lemon juice"), ("control/baked_salmon", "heat", "bake"),
    ("control/baked_salmon", "serve", "plate"), ("control/baked_salmon", "end", "dish"),
    ("control/tomato_soup", "fruit", "tomato"), ("control/tomato_soup", "liquid", "vegetable broth"), ("control/tomato_soup", "herb", "thyme"), ("control/tomato_soup", "cut", "dice"),
    ("control/tomato_soup", "heat", "simmer"), ("control/tomato_soup", "smooth", "blend"), ("control/tomato_soup", "spice", "season"), ("control/tomato_soup", "end", "dish"),
    ("control/cucumber_salad", "green", "cucumber"), ("control/cucumber_salad", "sour", "vinegar"), ("control/cucumber_salad", "cut", "slice"), ("control/cucumber_salad", "join", "toss"),
    ("control/cucumber_salad", "end", "dish"),
    ("control/heated_twice", "meat", "bacon"), ("control/heated_twice", "green", "peas"), ("control/heated_twice", "first", "fry"), ("control/heated_twice", "second", "steam"),
    ("control/heated_twice", "join", "stir"), ("control/heated_twice", "end", "dish"),
    ("structure/no_output", "grain", "rice"), ("structure/no_output", "liquid", "water"), ("structure/no_output", "heat", "steam"),
    ("structure/two_outputs", "ears", "corn"), ("structure/two_outputs", "heat", "grill"), ("structure/two_outputs", "end", "dish"), ("structure/two_outputs", "other", "dish"),
    ("structure/circle", "grain", "rice"), ("structure/circle", "liquid", "milk"), ("structure/circle", "one", "stir"), ("structure/circle", "two", "rest"), ("structure/circle", "end", "dish"),
    ("structure/output_goes_on", "stalk", "celery"), ("structure/output_goes_on", "cut", "chop"), ("structure/output_goes_on", "end", "dish"), ("structure/output_goes_on", "more", "garnish"),
    ("structure/forgotten_lime", "green", "zucchini"), ("structure/forgotten_lime", "sour", "lime"), ("structure/forgotten_lime", "heat", "grill"), ("structure/forgotten_lime", "end", "dish"),
    ("raw/tofu_sliced_only", "block", "tofu"), ("raw/tofu_sliced_only", "sauce", "soy sauce"), ("raw/tofu_sliced_only", "cut", "slice"), ("raw/tofu_sliced_only", "join", "fold"),
    ("raw/tofu_sliced_only", "end", "dish"),
    ("raw/one_of_two_ways", "sea", "shrimp"), ("raw/one_of_two_ways", "heat", "sear"), ("raw/one_of_two_ways", "cut", "mince"), ("raw/one_of_two_ways", "join", "mix"),
    ("raw/one_of_two_ways", "end", "dish"),
    ("raw/straight_to_dish", "fish", "salmon"), ("raw/straight_to_dish", "end", "dish"),
    ("blend/mushroom", "cap", "mushroom"), ("blend/mushroom", "liquid", "cream"), ("blend/mushroom", "smooth", "blend"), ("blend/mushroom", "heat", "simmer"), ("blend/mushroom", "end", "dish"),
    ("blend/spinach_among_liquids", "leaf", "spinach"), ("blend/spinach_among_liquids", "one", "water"), ("blend/spinach_among_liquids", "two", "lemon juice"),
    ("blend/spinach_among_liquids", "smooth", "blend"), ("blend/spinach_among_liquids", "end", "dish"),
    ("blend/second_blend", "base", "water"), ("blend/second_blend", "milk", "milk"), ("blend/second_blend", "head", "broccoli"), ("blend/second_blend", "one", "blend"),
    ("blend/second_blend", "two", "blend"), ("blend/second_blend", "end", "dish"),
    ("plate/roasted_afterwards", "stalk", "scallion"), ("plate/roasted_afterwards", "serve", "plate"), ("plate/roasted_afterwards", "heat", "roast"), ("plate/roasted_afterwards", "end", "dish"),
    ("plate/two_steps_later", "green", "peas"), ("plate/two_steps_later", "fat", "butter"), ("plate/two_steps_later", "serve", "plate"), ("plate/two_steps_later", "join", "stir"),
    ("plate/two_steps_later", "heat", "broil"), ("plate/two_steps_later", "end", "dish"),
    ("plate/two_plates", "bulb", "onion"), ("plate/two_plates", "one", "plate"), ("plate/two_plates", "heat", "toast"), ("plate/two_plates", "two", "plate"), ("plate/two_plates", "end", "dish"),
    ("liquid/dry_rice", "grain", "rice"), ("liquid/dry_rice", "heat", "simmer"), ("liquid/dry_rice", "end", "dish"),
    ("liquid/poached_in_nothing", "egg", "eggs"), ("liquid/poached_in_nothing", "heat", "poach"), ("liquid/poached_in_nothing", "serve", "plate"), ("liquid/poached_in_nothing", "end", "dish"),
    ("liquid/braise_without_inputs", "heat", "braise"), ("liquid/braise_without_inputs", "end", "dish"),
    ("combine/tossed_alone", "leaf", "lettuce"), ("combine/tossed_alone", "join", "toss"), ("combine/tossed_alone", "end", "dish"),
    ("combine/mixed_after_chopping", "green", "cucumber"), ("combine/mixed_after_chopping", "cut", "chop"), ("combine/mixed_after_chopping", "join", "mix"),
    ("combine/mixed_after_chopping", "serve", "plate"), ("combine/mixed_after_chopping", "end", "dish"),
    ("combine/nothing_combined", "join", "combine"), ("combine/nothing_combined", "end", "dish"),
    ("dangling/grated_for_nobody", "hard", "parmesan"), ("dangling/grated_for_nobody", "noodle", "fettuccine"), ("dangling/grated_for_nobody", "liquid", "water"),
    ("dangling/grated_for_nobody", "cut", "grate"), ("dangling/grated_for_nobody", "heat", "boil"), ("dangling/grated_for_nobody", "end", "dish"),
    ("dangling/last_step_open", "crumb", "breadcrumbs"), ("dangling/last_step_open", "heat", "toast"), ("dangling/last_step_open", "end", "dish"),
    ("season/only_spices", "one", "cumin"), ("season/only_spices", "two", "paprika"), ("season/only_spices", "spice", "season"), ("season/only_spices", "end", "dish"),
    ("season/no_inputs", "spice", "season"), ("season/no_inputs", "end", "dish"),
]

#: (case, from, to)
FLOWS = [
    ("control/baked_salmon", "fish", "heat"), ("control/baked_salmon", "sour", "heat"), ("control/baked_salmon", "heat", "serve"), ("control/baked_salmon", "serve", "end"),
    ("control/tomato_soup", "fruit", "cut"), ("control/tomato_soup", "cut", "heat"), ("control/tomato_soup", "liquid", "heat"), ("control/tomato_soup", "heat", "smooth"),
    ("control/tomato_soup", "smooth", "spice"), ("control/tomato_soup", "herb", "spice"), ("control/tomato_soup", "spice", "end"),
    ("control/cucumber_salad", "green", "cut"), ("control/cucumber_salad", "cut", "join"), ("control/cucumber_salad", "sour", "join"), ("control/cucumber_salad", "join", "end"),
    ("control/heated_twice", "meat", "first"), ("control/heated_twice", "first", "second"), ("control/heated_twice", "second", "join"), ("control/heated_twice", "green", "join"),
    ("control/heated_twice", "join", "end"),
    ("structure/no_output", "grain", "heat"), ("structure/no_output", "liquid", "heat"),
    ("structure/two_outputs", "ears", "heat"), ("structure/two_outputs", "heat", "end"), ("structure/two_outputs", "heat", "other"),
    ("structure/circle", "grain", "one"), ("structure/circle", "liquid", "one"), ("structure/circle", "one", "two"), ("structure/circle", "two", "one"), ("structure/circle", "two", "end"),
    ("structure/output_goes_on", "stalk", "cut"), ("structure/output_goes_on", "cut", "end"), ("structure/output_goes_on", "end", "more"),
    ("structure/forgotten_lime", "green", "heat"), ("structure/forgotten_lime", "heat", "end"),
    ("raw/tofu_sliced_only", "block", "cut"), ("raw/tofu_sliced_only", "cut", "join"), ("raw/tofu_sliced_only", "sauce", "join"), ("raw/tofu_sliced_only", "join", "end"),
    ("raw/one_of_two_ways", "sea", "heat"), ("raw/one_of_two_ways", "sea", "cut"), ("raw/one_of_two_ways", "heat", "join"), ("raw/one_of_two_ways", "cut", "join"), ("raw/one_of_two_ways", "join", "end"),
    ("raw/straight_to_dish", "fish", "end"),
    ("blend/mushroom", "cap", "smooth"), ("blend/mushroom", "liquid", "smooth"), ("blend/mushroom", "smooth", "heat"), ("blend/mushroom", "heat", "end"),
    ("blend/spinach_among_liquids", "one", "smooth"), ("blend/spinach_among_liquids", "leaf", "smooth"), ("blend/spinach_among_liquids", "two", "smooth"), ("blend/spinach_among_liquids", "smooth", "end"),
    ("blend/second_blend", "base", "one"), ("blend/second_blend", "milk", "one"), ("blend/second_blend", "one", "two"), ("blend/second_blend", "head", "two"), ("blend/second_blend", "two", "end"),
    ("plate/roasted_afterwards", "stalk", "serve"), ("plate/roasted_afterwards", "serve", "heat"), ("plate/roasted_afterwards", "heat", "end"),
    ("plate/two_steps_later", "green", "serve"), ("plate/two_steps_later", "serve", "join"), ("plate/two_steps_later", "fat", "join"), ("plate/two_steps_later", "join", "heat"),
    ("plate/two_steps_later", "heat", "end"),
    ("plate/two_plates", "bulb", "one"), ("plate/two_plates", "one", "heat"), ("plate/two_plates", "heat", "two"), ("plate/two_plates", "two", "end"),
    ("liquid/dry_rice", "grain", "heat"), ("liquid/dry_rice", "heat", "end"),
    ("liquid/poached_in_nothing", "egg", "heat"), ("liquid/poached_in_nothing", "heat", "serve"), ("liquid/poached_in_nothing", "serve", "end"),
    ("liquid/braise_without_inputs", "heat", "end"),
    ("combine/tossed_alone", "leaf", "join"), ("combine/tossed_alone", "join", "end"),
    ("combine/mixed_after_chopping", "green", "cut"), ("combine/mixed_after_chopping", "cut", "join"), ("combine/mixed_after_chopping", "join", "serve"), ("combine/mixed_after_chopping", "serve", "end"),
    ("combine/nothing_combined", "join", "end"),
    ("dangling/grated_for_nobody", "hard", "cut"), ("dangling/grated_for_nobody", "noodle", "heat"), ("dangling/grated_for_nobody", "liquid", "heat"), ("dangling/grated_for_nobody", "heat", "end"),
    ("dangling/last_step_open", "crumb", "heat"),
    ("season/only_spices", "one", "spice"), ("season/only_spices", "two", "spice"), ("season/only_spices", "spice", "end"),
    ("season/no_inputs", "spice", "end"),
]

NODE_COLUMNS = "recipe_id, pos, node_id, node_type, name, category, is_protein, is_liquid, op_type, grp, params"


def node_rows() -> list[tuple]:
    """The nodes with their payloads: (NODE_COLUMNS), pos counting from 0 in each case."""
    known = {r[1]: r[1:5] for r in ingredient_rows()}
    rows, places = [], {}
    for case, node, what in STEPS:
        pos = places[case] = places.get(case, -1) + 1
        if what == "dish":
            rows.append((case, pos, node, "dish_output", None, None, False, False, None, None, None))
        elif what in GROUP_OF:
            rows.append((case, pos, node, "operation", None, None, False, False, what, GROUP_OF[what], "{}"))
        else:
            rows.append((case, pos, node, "ingredient", *known[what], None, None, None))
    return rows


def edge_rows() -> list[tuple]:
    return [(case, src, dst, k) for k, (case, src, dst) in enumerate(FLOWS)]


def suite(spark) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(labelled, recipes, nodes, edges): the labelled cases and their graphs in long form."""
    kinds = dict.fromkeys(NODE_COLUMNS.split(", "), "string") | {"pos": "int", "is_protein": "boolean", "is_liquid": "boolean"}
    return (
        spark.createDataFrame([(case, case, rule) for case, rule, _, _ in CASES], "case_name string, recipe_id string, expected_rule string"),
        spark.createDataFrame([(case, dish, category) for case, _, dish, category in CASES], "recipe_id string, dish_name string, category string"),
        spark.createDataFrame(node_rows(), ", ".join(f"{c} {t}" for c, t in kinds.items())),
        spark.createDataFrame(edge_rows(), "recipe_id string, src string, dst string, edge_seq int"),
    )
