import json

import pytest

from potflow.operators import evaluation
from potflow.operators.parsing import parse, parsed, response_graphs, unfenced
from potflow.operators.rules import verified
from potflow.operators.vocabulary import classified, dim_ingredient, dim_operation, ingredient_rows, operation_rows, rewrite_groups

VOCABULARY = {r[0]: r[1:5] for r in ingredient_rows()}


def good(**changes):
    data = {
        "dish_name": "Soup",
        "category": "soup",
        "nodes": [
            {"node_id": "a", "node_type": "ingredient", "ingredient": {"name": "Chicken Broth", "category": "x"}},
            {"node_id": "b", "node_type": "operation", "operation": {"op_type": "boil", "params": {"minutes": 3}}},
            {"node_id": "c", "node_type": "dish_output"},
        ],
        "edges": [["a", "b"], ["b", "c"]],
    }
    for k, v in changes.items():
        data.pop(k) if v is ... else data.__setitem__(k, v)
    return data


def with_node(i, **node):
    data = good()
    data["nodes"][i].update(node)
    return data


def outcome(data, raw=None):
    p = parsed(json.dumps(data) if raw is None else raw, VOCABULARY)
    return p.status if p.status != "failed" else p.code


J = json.dumps(good())
CASES = [
    ("success", J),
    ("success", f"```json\n{J}\n```"),
    ("success", f"```\n{J}"),
    ("success", f"  {J}\n"),
    ("json_parse_error", f"```json {J}```"),
    ("json_parse_error", J[:-1]),
    ("json_parse_error", J + " done"),
    ("json_parse_error", ""),
    ("json_parse_error", "[1]"),
    ("json_parse_error", "null"),
    ("out_of_scope", json.dumps(good(category="out_of_scope", nodes=[], edges=...))),
    ("out_of_scope", json.dumps(good(category=...))),
    ("unknown_category", json.dumps(good(category="dessert"))),
    ("unknown_category", json.dumps(good(category=None))),
    ("unknown_category", json.dumps(good(category="Soup"))),
    ("unknown_op_type", json.dumps(with_node(1, operation={"op_type": "flambe"}))),
    ("unknown_op_type", json.dumps(with_node(1, operation={"op_type": "Chop"}))),
    ("unknown_op_type", json.dumps(with_node(1, operation={}))),
    ("success", json.dumps(with_node(1, operation={"op_type": "finish"}))),
    ("success", json.dumps(with_node(1, operation={"op_type": "COMBINE"}))),
    ("dag_construction_error", json.dumps(good(dish_name=...))),
    ("dag_construction_error", json.dumps(good(nodes=None))),
    ("dag_construction_error", json.dumps(good(edges=...))),
    ("dag_construction_error", json.dumps(good(edges=[["a", "b", "c"]]))),
    ("success", json.dumps(good(edges=["ab", "bc"]))),
    ("dag_construction_error", json.dumps(good(edges=["abc"]))),
    ("dag_construction_error", json.dumps(with_node(0, ingredient={"name": "moon dust"}))),
    ("success", json.dumps(with_node(0, ingredient={"name": "moon dust", "category": "PROTEIN"}))),
    ("dag_construction_error", json.dumps(with_node(0, ingredient={"name": None, "category": "fat"}))),
    ("dag_construction_error", json.dumps(with_node(0, ingredient="salt"))),
    ("dag_construction_error", json.dumps(with_node(0, node_type="spice"))),
    ("dag_construction_error", json.dumps(with_node(1, operation={"op_type": 3}))),
]


@pytest.mark.parametrize("expected,raw", CASES)
def test_outcomes(expected, raw):
    assert outcome(None, raw) == expected


def test_normalisation():
    p = parsed(json.dumps(with_node(1, operation={"op_type": "FINISH"})), VOCABULARY)
    assert [n["op_type"] for n in p.nodes] == [None, "plate", None]
    assert p.nodes[0]["name"] == "chicken broth" and p.nodes[0]["is_liquid"] and p.nodes[0]["category"] == "liquid"
    p = parsed(json.dumps(with_node(0, ingredient={"name": "moon dust", "category": "PROTEIN", "is_protein": True})), VOCABULARY)
    assert (p.nodes[0]["category"], p.nodes[0]["is_protein"], p.nodes[0]["is_liquid"]) == ("vegetable", True, False)
    twice = good()
    twice["nodes"].append({"node_id": "a", "node_type": "ingredient", "ingredient": {"name": "salt"}})
    assert [(n["node_id"], n["pos"], n["name"]) for n in parsed(json.dumps(twice), VOCABULARY).nodes] == [("a", 0, "salt"), ("b", 1, None), ("c", 2, None)]
    assert parsed(None, VOCABULARY).code == "api_error"
    assert unfenced("```") == "" and unfenced(" x ") == "x"


def test_parse_and_coverage(spark):
    raws = [r for _, r in CASES] + [None, J]
    rows = spark.createDataFrame([(f"id{i}", f"r{i}", 1, raw) for i, raw in enumerate(raws)], "response_id string, recipe_id string, attempt int, raw string")
    out = parse(rows, dim_ingredient(spark))
    assert {r.response_id: r.failure_code or r.status for r in out.collect()} == {f"id{i}": x for i, x in enumerate([e for e, _ in CASES] + ["api_error", "success"])}
    report = evaluation.reported(out)
    counts = evaluation.counters(report).first()
    n = len(raws)
    assert counts.n_attempted == n and counts.n_parse_success + counts.n_out_of_scope + counts.n_parse_failed == n
    assert counts.n_valid + counts.n_invalid == counts.n_parse_success and counts.pct_success == round(100 * counts.n_parse_success / n, 1)
    assert [r.failure_code for r in evaluation.failure_histogram(report).orderBy("place").collect()][0] == "dag_construction_error"
    assert verified(response_graphs(out)).where("recipe_id = 'id0'").first().is_valid
    empty = evaluation.counters(evaluation.reported(parse(rows.limit(0), dim_ingredient(spark)))).first()
    assert empty.n_attempted == 0 and empty.pct_success is None


def test_vocabularies(spark):
    operations, ingredients = operation_rows(), ingredient_rows()
    assert len(operations) == len({r[0] for r in operations}) == 32 and len(ingredients) == len({r[0] for r in ingredients}) == 60
    assert sum(r[5] for r in ingredients) == 6 and sum(r[4] for r in ingredients) >= 5
    assert {r[2]: sum(x[2] == r[2] for x in ingredients) for r in ingredients} == dict(protein=9, vegetable=12, allium=4, grain=6, dairy=6, fat=3, seasoning=10, liquid=7, fruit=3)
    assert {r.grp: len(r.operations.split(",")) for r in rewrite_groups(dim_operation(spark)).collect()} == dict(prep=8, dry_heat=8, moist_heat=5, combine=7, finish=4)
    golden = {
        "chicken breast": ("protein", True, False), "chicken broth": ("protein", True, True), "eggplant": ("protein", True, False), "champagne": ("protein", True, False),
        "graham cracker": ("protein", True, False), "soy sauce": ("liquid", False, True), "coconut milk": ("liquid", False, True), "garlic powder": ("seasoning", False, False),
        "garlic": ("allium", False, False), "spring_onion": ("allium", False, False), "pepper": ("seasoning", False, False), "bell pepper": ("vegetable", False, False), "foil": ("liquid", False, True),
    }
    rows = [(n, None, i) for i, n in enumerate(golden)] + [("", "", 90), (None, None, 91), (None, "stir", 92), ("GARLIC", None, 93)]
    got = {r.vocab_key: r for r in classified(spark.createDataFrame(rows, "name string, verb string, pos long")).collect()}
    for name, expected in golden.items():
        r = got[name.replace(" ", "_")]
        assert (r.category, r.is_protein, r.is_liquid) == expected, name
    assert got["spring_onion"].name == "spring onion" and got["garlic"].name == "GARLIC" and "stir" in got and len(got) == 14


def test_vocabularies_of_any_size(spark, sf):
    """A vocabulary that is joined gives what a broadcast one gives."""
    from potflow.operators.parsing import distinct_responses

    rows, names = distinct_responses(spark.read.parquet(f"{sf}/responses.parquet")), spark.read.parquet(f"{sf}/dim_ingredient.parquet")
    one, other = ({str(r) for r in parse(rows, names, broadcast=k).collect()} for k in (100_000, 3))
    assert one == other and len(one) > 20
