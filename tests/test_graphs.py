from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from potflow.operators import evaluation, graphs, long_rules, rules
from potflow.operators.vocabulary import GROUP_OF, ingredient_rows

NODE_DDL = "recipe_id string, pos int, node_id string, node_type string, name string, category string, is_protein boolean, is_liquid boolean, op_type string, grp string, params string"
KNOWN = {r[0]: r[1:5] for r in ingredient_rows()}


def tables(spark, cases):
    """cases: name -> (nodes [(id, kind, what)], edges [(src, dst)])"""
    recipes, nodes, edges = [], [], []
    for case, (ns, es) in cases.items():
        recipes.append((case, case, "pasta"))
        for pos, (node, kind, what) in enumerate(ns):
            if kind == "ingredient":
                payload = (*KNOWN[what], None, None, None) if isinstance(what, str) else (*what, None, None, None)
            else:
                payload = (None, None, False, False, what, GROUP_OF.get(what), None)
            nodes.append((case, pos, node, kind, *payload))
        edges += [(case, s, d, k) for k, (s, d) in enumerate(es)]
    return (
        spark.createDataFrame(recipes, "recipe_id string, dish_name string, category string"),
        spark.createDataFrame(nodes, NODE_DDL),
        spark.createDataFrame(edges, "recipe_id string, src string, dst string, edge_seq int"),
    )


def fired(spark, cases):
    rows = rules.verified(graphs.nested(*tables(spark, cases))).collect()
    return {r.recipe_id: [(v.rule, list(v.node_ids)) for v in r.violations] for r in rows}, {r.recipe_id: r for r in rows}


def ing(node, what):
    return node, "ingredient", what


def op(node, what):
    return node, "operation", what


OUT = ("out", "dish_output", None)
SIMPLE = ([ing("i_eggs", "eggs"), ing("i_butter", "butter"), op("op_saute", "saute"), op("op_plate", "plate"), OUT], [("i_eggs", "op_saute"), ("i_butter", "op_saute"), ("op_saute", "op_plate"), ("op_plate", "out")])
CYCLE = ([ing("a", "eggs"), op("op_a", "saute"), op("op_b", "plate"), OUT], [("a", "op_a"), ("op_a", "op_b"), ("op_b", "op_a"), ("op_b", "out")])


def test_suite_has_full_recall(spark):
    results = evaluation.suite_results(spark)
    summary = evaluation.recall_summary(results).first()
    assert (summary.n_total, summary.n_violation_cases, summary.n_control_cases) == (28, 24, 4)
    assert (summary.true_positives, summary.false_negatives, summary.false_positives, summary.recall) == (24, 0, 0, 1.0)
    rows = {r.case_name: r for r in results.collect()}
    assert rows["raw/tofu_sliced_only"].fired == "raw_protein_before_plate" and rows["combine/nothing_combined"].status == "✓ caught"
    assert rows["control/heated_twice"].status == "✓ no false positive" and rows["structure/circle"].fired == "dag_structure"
    by_rule = {r.expected_rule: (r.tp, r.fn) for r in evaluation.recall_by_rule(results).collect()}
    assert set(by_rule) == {r.name for r in rules.RULES} and all(tp >= 2 and not fn for tp, fn in by_rule.values())


def test_results_of_missed_and_false_cases(spark):
    labelled = spark.createDataFrame([("miss", "a", "season_needs_target"), ("false", "b", "none")], "case_name string, recipe_id string, expected_rule string")
    verdicts = spark.createDataFrame([("a", True, []), ("b", False, [(0, "dag_structure", "m", [])])], "recipe_id string, is_valid boolean, violations array<struct<rule_ord int, rule string, message string, node_ids array<string>>>")
    rows = {r.case_name: (r.outcome, r.status) for r in evaluation.case_results(labelled, verdicts).collect()}
    assert rows == {"miss": ("FN", "✗ MISSED (got: nothing)"), "false": ("FP", "✗ FALSE POSITIVE: dag_structure")}
    assert evaluation.recall_summary(evaluation.case_results(labelled.limit(0), verdicts)).first().recall == 0.0


def test_rules(spark):
    got, rows = fired(
        spark,
        {
            "simple": SIMPLE,
            "cycle": CYCLE,
            "no_output": ([ing("e", "eggs"), op("p", "plate")], [("e", "p")]),
            "unused": ([ing("e", "eggs"), ing("b", "butter"), op("p", "plate"), OUT], [("e", "p"), ("p", "out")]),
            "blend": ([ing("c", "carrot"), ing("t", "tomato"), op("b", "blend"), OUT], [("c", "b"), ("t", "b"), ("b", "out")]),
            "same_edge_twice": ([ing("w", "water"), op("m", "mix"), OUT], [("w", "m"), ("w", "m"), ("m", "out")]),
            "steam_dry": ([ing("c", "carrot"), op("s", "steam"), OUT], [("c", "s"), ("s", "out")]),
            "whisk_one": ([ing("w", "water"), op("k", "whisk"), OUT], [("w", "k"), ("k", "out")]),
            "boil_after_operation": ([ing("c", "carrot"), op("c1", "chop"), op("b", "boil"), OUT], [("c", "c1"), ("c1", "b"), ("b", "out")]),
            "two_outputs": ([ing("e", "eggs"), ing("w", "water"), OUT, ("out2", "dish_output", None)], [("w", "out"), ("e", "out2")]),
            "output_feeds": ([ing("w", "water"), op("r", "rest"), OUT], [("w", "r"), ("r", "out"), ("out", "r")]),
            "isolated": ([ing("w", "water"), op("b", "boil"), op("s", "season"), OUT], [("w", "out")]),
            "unflagged": ([ing("x", ("mystery meat", "protein", False, False)), OUT], [("x", "out")]),
            "self_loop": ([ing("w", "water"), op("m", "stir"), OUT], [("w", "m"), ("m", "m"), ("m", "out")]),
            "empty": ([], []),
            "broken": ([ing("w", "water"), OUT], [("w", "out"), ("w", "nowhere"), ("ghost", "out")]),
        },
    )
    name = lambda case: [r for r, _ in got[case]]
    assert got["simple"] == [] and rows["simple"].is_valid
    assert got["cycle"] == [("dag_structure", []), ("no_heat_after_plate", ["op_b", "op_a"])]
    assert rows["cycle"].violations[0].message == "RecipeDAG 'cycle' contains a cycle — not a valid DAG."
    assert got["no_output"] == [("dag_structure", []), ("no_dangling_outputs", ["p"])]
    assert rows["no_output"].violations[0].message == "Expected 1 DISH_OUTPUT node, found 0"
    assert got["unused"] == [("dag_structure", []), ("raw_protein_before_plate", ["e"])]
    assert rows["unused"].violations[0].message == "Ingredient 'butter' (b) has no outgoing edges — unused"
    assert got["blend"] == [("solid_before_blend", ["c", "b"]), ("solid_before_blend", ["t", "b"])]
    assert got["same_edge_twice"] == got["steam_dry"] == got["whisk_one"] == got["boil_after_operation"] == got["unflagged"] == []
    assert name("two_outputs") == ["dag_structure"]
    assert name("output_feeds") == ["dag_structure", "dag_structure"]
    assert got["isolated"] == [("moist_heat_needs_liquid", ["b"]), ("no_dangling_outputs", ["b"]), ("no_dangling_outputs", ["s"]), ("season_needs_target", ["s"])]
    assert name("self_loop") == ["dag_structure"]
    assert name("empty") == ["dag_structure"] and not rows["empty"].is_valid
    assert rows["broken"].failure_code == "edge_reference_error" and got["broken"] == [] and not rows["broken"].is_valid


def test_texts_order_and_verdict_words(spark):
    graph = graphs.nested(*tables(spark, {"Test Dish": SIMPLE, "loop": CYCLE, "bare": ([OUT], [])}))
    texts = {r.recipe_id: r.text for r in graphs.texts(graph).collect()}
    assert texts["Test Dish"] == "A dish of Test Dish. Ingredients: eggs, butter. Preparation: saute eggs and butter; plate saute."
    assert texts["loop"] is None and texts["bare"].endswith("Preparation: combine all ingredients.")
    order = [r.node_id for r in graphs.topological(graph).where("recipe_id = 'Test Dish'").orderBy("rank").collect()]
    assert order == ["i_eggs", "i_butter", "op_saute", "op_plate", "out"]
    assert {r.recipe_id: r.n_stuck for r in graphs.cyclic(graph).collect()} == {"loop": 3}
    words = {r.recipe_id: r.text for r in rules.verdict_texts(rules.verified(graph)).collect()}
    assert words["Test Dish"] == "✓ Recipe is valid (no constraint violations)"
    assert words["loop"].split("\n")[0] == "✗ Recipe has 2 violation(s):" and "(nodes: —)" in words["loop"] and "(nodes: op_b, op_a)" in words["loop"]


def fifo(n, edges):
    """Queue-based order of positions, for comparison."""
    waiting = [sum(d == i for _, d in edges) for i in range(n)]
    queue, order = deque(i for i in range(n) if not waiting[i]), []
    while queue:
        i = queue.popleft()
        order.append(i)
        for s, d in edges:
            if s == i:
                waiting[d] -= 1
                if not waiting[d]:
                    queue.append(d)
    return order


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12), min_size=40, max_size=60))
def test_topological_order_equals_a_queue(spark, many):
    cases = {f"g{k}": ([(f"n{i}", "operation", "stir") for i in range(7)], [(f"n{s}", f"n{d}") for s, d in edges]) for k, edges in enumerate(many)}
    rows = graphs.topological(graphs.nested(*tables(spark, cases))).collect()
    for k, edges in enumerate(many):
        got = [r.node_id for r in sorted((r for r in rows if r.recipe_id == f"g{k}"), key=lambda r: r.rank)]
        assert got == [f"n{i}" for i in fifo(7, edges)]


def test_heat_only_removes_raw_protein(spark):
    without = ([ing("e", "eggs"), op("m", "whisk"), op("x", "chop"), OUT], [("e", "m"), ("m", "x"), ("x", "out")])
    withheat = ([ing("e", "eggs"), op("m", "whisk"), op("x", "bake"), OUT], [("e", "m"), ("m", "x"), ("x", "out")])
    got, _ = fired(spark, {"a": without, "b": withheat})
    assert [r for r, _ in got["a"]] == ["raw_protein_before_plate"] and got["b"] == []


def test_registry_takes_rules(spark):
    registry = rules.RuleRegistry()
    registry.add("too_small", "CASE WHEN n < 3 THEN array(struct('too small' AS message, array(ids[0]) AS node_ids)) ELSE cast(array() AS array<struct<message: string, node_ids: array<string>>>) END")
    with pytest.raises(ValueError):
        registry.add("too_small", "")
    rows = rules.verified(graphs.nested(*tables(spark, {"s": ([ing("w", "water"), OUT], [("w", "out")])})), registry).first()
    assert [(v.rule_ord, v.rule) for v in rows.violations] == [(8, "too_small")]


def test_dirty_tables(spark):
    """Keys written differently, copies, a node_id given twice, null keys, null members, extra columns."""
    from datetime import datetime

    t = datetime(2024, 1, 1)
    node = "recipe_id string, node_id string, node_seq int, node_type string, ingredient struct<name: string, category: string, is_protein: boolean, is_liquid: boolean>, operation struct<op_type: string, params: string>, loaded_at timestamp_ntz, pos string"
    raw = spark.createDataFrame(
        [
            (" R1", "N0", 0, "ingredient", ("salt", "seasoning", None, None), None, t, "x"),
            ("r1", "n0", 0, "ingredient", ("salt", "seasoning", None, None), None, t, "x"),
            ("r1", "n1", 1, "operation", None, ("stir", "{}"), t, "x"),
            ("r1", "n1", 5, "operation", None, ("bake", "{}"), t, "x"),
            ("r1", None, 7, "operation", None, ("bake", "{}"), t, "x"),
            (None, "n1", 1, "operation", None, ("bake", "{}"), t, "x"),
            ("r1", "n2", 2, "ingredient", None, None, t, "x"),
        ],
        node,
    )
    rows = {r.node_id: r for r in graphs.nodes(raw).collect()}
    assert set(rows) == {"n0", "n1", "n2"}
    assert (rows["n1"].op_type, rows["n1"].pos, rows["n1"].grp) == ("bake", 1, "dry_heat") and rows["n0"].is_protein is False
    edges = graphs.edges(spark.createDataFrame([("R1", "n0", " N1", 0, t), ("r1", "n0", "n1", 0, t), ("r1", "n0", "n1", 1, t), ("r1", None, "n1", 2, t)], "recipe_id string, src string, dst string, edge_seq int, loaded_at timestamp_ntz"))
    assert edges.count() == 3
    recipes = graphs.recipes(spark.createDataFrame([("R1 ", "d", "soup", t), ("r1", "d", "soup", t), (None, "x", "soup", t)], "recipe_id string, dish_name string, category string, loaded_at timestamp_ntz"))
    row = rules.verified(graphs.nested(recipes, graphs.nodes(raw), edges)).first()
    assert row.failure_code == "dag_construction_error" and not row.is_valid
    assert {(r.node_id, r.n_in, r.n_out) for r in graphs.degrees(graphs.nodes(raw), edges).collect()} == {("n0", 0, 2), ("n1", 3, 0), ("n2", 0, 0)}
    assert rules.verified(graphs.nested(recipes.limit(0), graphs.nodes(raw), edges)).count() == 0


def test_chain_in_order_and_against_it(spark):
    chain = [ing("e", "eggs"), *(op(f"o{i}", "plate" if i == 3 else "stir") for i in range(70)), op("h", "bake"), op("p", "plate"), OUT]
    edges = [(a[0], b[0]) for a, b in zip(chain, chain[1:])]
    short = chain[:4] + chain[-3:]
    got, _ = fired(spark, {"chain": (chain, edges), "back": (chain[::-1], edges), "short": (short, [(a[0], b[0]) for a, b in zip(short, short[1:])])})
    assert got["chain"] == got["back"] == [("no_heat_after_plate", ["o3", "h"])] and got["short"] == []


def test_long_rules_give_the_same(spark):
    """Random graphs with cycles, several outputs and edges to nowhere."""
    import random

    rng = random.Random(7)
    kinds = [("ingredient", "eggs"), ("ingredient", "water"), ("ingredient", "salt"), ("operation", "plate"), ("operation", "boil"), ("operation", "season"), ("operation", "blend"), ("operation", "mix"), ("operation", "saute")]
    cases = {}
    for g in range(40):
        nodes = [(f"n{i}", *rng.choice(kinds)) for i in range(rng.randint(0, 5))] + [OUT] * (rng.random() < 0.8)
        ids = [n[0] for n in nodes] + ["ghost"] * (rng.random() < 0.2)
        cases[f"g{g}"] = (nodes, [(rng.choice(ids), rng.choice(ids)) for _ in range(rng.randint(0, 8))] if ids else [])
    long = tables(spark, cases)
    own = {(r.recipe_id, v.rule, v.message, ",".join(v.node_ids)) for r in rules.verified(graphs.nested(*long)).collect() for v in r.violations}
    assert own == {(r.recipe_id, r.rule, r.message, r.nodes) for r in long_rules.violations(*long).collect()} and len(own) > 20


def test_recipes_beyond_a_row_go_the_long_way(spark):
    """Small and large recipes in one call give what the row form gives for all; sizes at the border included."""
    chain = lambda n: ([ing("e", "eggs"), *(op(f"o{i}", "stir") for i in range(n)), OUT], [(a, b) for a, b in zip(["e", *(f"o{i}" for i in range(n))], [*(f"o{i}" for i in range(n)), "out"])])
    long = tables(spark, {"small": chain(2), "border": chain(4), "large": chain(9), "loop": CYCLE})
    want = {(r.recipe_id, r.rule, r.message, r.nodes) for r in long_rules.violations(*long).collect()}
    for most in (0, 11, 5_000):
        assert {(r.recipe_id, r.rule, r.message, r.nodes) for r in long_rules.of_any_size(*long, most=most).collect()} == want
    assert long_rules.of_any_size(*(df.limit(0) for df in long)).count() == 0


def test_order_of_a_long_chain_takes_a_moment(spark):
    """20,000 nodes against their order: the walk follows the front and doesn't rescan the graph."""
    import time

    import pyarrow as pa

    from potflow.operators import walks

    n = 20_000
    edges = pa.array([[{"s": i + 1, "d": i, "q": i} for i in range(n - 1)], []])
    began = time.time()
    rank, level = walks.ordered(walks.Batch(pa.array([n, 1], pa.int32()), edges))
    assert rank[:n].tolist() == level[:n].tolist() == list(range(n))[::-1] and rank[n] == 0 and time.time() - began < 30


def test_plans_of_walks_dont_grow_with_their_rounds(spark):
    chain = spark.range(9).selectExpr("'r' AS recipe_id", "concat('n', id) AS node_id", "concat('n', id + 1) AS to")
    found = long_rules.reached(chain.limit(1).select("recipe_id", "node_id"), chain, ["recipe_id"])
    assert found.count() == 10 and found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
