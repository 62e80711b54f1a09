import json
import random

from potflow.operators import nested


def test_usable():
    obj = {"a": [1, {"b": "x"}], "nodes": []}
    j = json.dumps(obj)
    for raw in (j, f"```json\n{j}\n```", f"Sure.\n\n{j}\nHope this helps", json.dumps(j), json.dumps(json.dumps(j)), f"I mean {{this}}: {j}", f"{j} {j}", f"here: {json.dumps(j)}"):
        assert nested.usable(raw) == obj, raw
    for raw in (None, "", "null", "[]", f"[{j}]", "I cannot parse this dish.", j[:-1], j[:-3] + " and so on", '{"a": NaN}', f'{j} {{"other": 1}}', '"text"', "{" * 100_000):
        assert nested.usable(raw) is None, str(raw)[:50]


def test_deep_text_decodes_as_any_other():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind > 4:
            inner = [value(depth - 1) for _ in range(rng.randint(0, 3))]
            return inner if kind == 5 else {rng.choice(['k"', "", "é/x", "a"]) + str(i): x for i, x in enumerate(inner)}
        return [None, True, -1.5e3, "t\n\u2028\\", 7][kind]

    for _ in range(300):
        v = value(5)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert nested.decoded_deep(f" {text} tail")[0] == v
        bad = text[: rng.randint(0, len(text) - 1)] + rng.choice(["", "}", ",", "x"])
        try:
            json.loads(bad)
        except ValueError:
            try:
                _, end = nested.decoded_deep(bad)
                assert bad[end:].strip()
            except ValueError:
                pass
    for depth in (20_000, 100_000):
        deep = "[" * depth + "1" + "]" * depth
        assert nested.decoded(deep)[0] is not None and nested.usable(f'so: {{"a": {deep}}}') is not None and nested.usable(f'{{"a": {deep[:-1]}}}') is None


def test_identities_are_equal_for_equal_objects():
    m = nested.Merkle()
    a, b = m.identity({"x": 1, "y": [1, {"z": None}]}), m.identity({"y": [1, {"z": None}], "x": 1})
    assert a == b and a[2] == 3
    assert len(m.new) == 3 and m.identity({"x": 1, "y": '[1, {"z": null}]'})[0] == a[0]
    assert m.identity({"x": "1"})[0] != m.identity({"x": 1})[0] and m.identity([])[0] != m.identity({})[0]
    assert m.identity("plain") == (None, '"plain"', 0) and m.identity(None) == (None, None, 0)


RESPONSES = "recipe_id string, attempt int, prompt_hash string, raw string, received_at timestamp_ntz, member string"


def raw(*nodes):
    return json.dumps({"nodes": list(nodes)})


def test_found(spark, layer1, save):
    node = {"ingredient": {"name": "salt", "alt": [{"name": "x"}], "note": None, "tags": []}, "operation": {"op_type": "mix", "params": {"a": [{"b": ""}], "c": {}}}}
    shared = {"operation": {"params": '{"minutes": "60"}'}}
    folder = save(
        responses=spark.createDataFrame(
            [
                (" R1", 1, "h", raw(node, {"ingredient": "pepper"}, "no object", shared, None), None, "x"),
                ("r1", 1, "h", raw(node, {"ingredient": "pepper"}, "no object", shared, None), None, "x"),
                ("r2", 2, "h", raw(shared, shared, {"operation": {"params": 5}}, {"operation": None, "ingredient": None}), None, "x"),
                (None, 1, "h", raw(node), None, "x"),
                ("r3", 1, "h", raw(node)[:-4], None, "x"),
                ("r4", 1, "h", None, None, "x"),
                ("r5", None, "h", json.dumps({"nodes": None}), None, "x"),
            ],
            RESPONSES,
        ),
        layer1=layer1([("A", "t", ["x", None, False, " "], None, 1), ("a ", "t", ["new", None, "z"], [], 2), ("b", None, None, ["s"], 1)], extra=("pos", "member")),
    )
    got = {tuple(r) for r in nested.p2_found(spark, folder).collect()}
    paths = {(0, "ingredient/name"), (0, "ingredient/alt/0/name"), (0, "params/a/0/b"), (1, "ingredient"), (3, "params/minutes")}
    expected = {("responses", "r1", 1, *p) for p in paths} | {("responses", "r2", 2, i, "params/minutes") for i in (0, 1)} | {("responses", "r2", 2, 2, "params")}
    assert got == expected | {("layer1", "a", 0, 0, "ingredients"), ("layer1", "a", 0, 2, "ingredients"), ("layer1", "b", 0, 0, "instructions")}
    flat = nested.flatten_responses(spark.read.parquet(f"{folder}/responses.parquet"))
    bridges = flat["bridges"].collect()
    known = {r.object_id: r.n_occurrences for r in flat["objects"].collect()}
    assert [known[r.object_id] for r in bridges if r.member == "minutes"] == [3]
    status = {(r.recipe_id, r.attempt): r.status for r in nested.p2_records(spark, folder).collect()}
    assert status == {("r1", 1): "usable", ("r2", 2): "usable", ("r3", 1): "unusable", ("r4", 1): "no_text", ("r5", None): "no_nodes"}
    assert all(r.child_id is None or r.child_id in known for r in bridges) and len({(r.object_id, r.ordinal) for r in bridges}) == len(bridges)
    assert nested.p2_objects(spark, folder).count() == len(known)


def test_empty(spark, layer1, save):
    folder = save(responses=spark.createDataFrame([], RESPONSES), layer1=layer1([]))
    assert nested.p2_found(spark, folder).count() == 0 and nested.p2_objects(spark, folder).count() == 0


def test_deep_and_mixed_records(spark, layer1, save):
    """Chains far beyond the interpreter's recursion, a broad tree of every height, and objects that stand at many heights."""
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    rng = random.Random(1)

    def tree(n):
        return {f"k{i}": tree(rng.randint(0, n - 1)) for i in range(rng.randint(1, 2))} | {"v": n, "w": [None, str(n)]} if n else rng.choice([0, "x", {}, [1]])

    tall = tree(30)
    values = {"chain": deep(5_000, '{"b": [1, 2]}'), "leap": deep(2 * nested.LEAP - 1, "7"), "tall": json.dumps(tall), "sub": deep(nested.LOW + 3, '{"b": [1, 2]}'), "forked": deep(300, json.dumps({"l": tall, "r": [tall, 5]}))}
    rows = [(name, 1, "h", f'{{"nodes": [{{"operation": {{"params": {v}}}}}, {{"ingredient": {{"name": "x"}}}}]}}', None, "x") for name, v in values.items()]
    folder = save(responses=spark.createDataFrame(rows, RESPONSES), layer1=layer1([]))

    def paths(text):
        out, stack = set(), [("params", nested.decoded(text))]
        while stack:
            at, v = stack.pop()
            if isinstance(v, (dict, list)):
                stack += [(f"{at}/{k}", x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v))]
            elif v is not None:
                out.add(at)
        return out

    got = {}
    for r in nested.p2_found(spark, folder).collect():
        got.setdefault(r.record_key, []).append(r.path)
    for name, v in values.items():
        assert sorted(got[name]) == sorted([*paths(v), "ingredient/name"]), name


def test_layer1_arrays_are_stored_once(spark, layer1):
    flat = nested.flatten_layer1(layer1([("a", "t", ["x", None, " "], ["x"], 1), ("b", "t", ["x", None, " "], [], 1), ("c", "t", ["x", "", " "], None, 1)]))
    objects = {r.object_id: r.n_occurrences for r in flat["objects"].collect()}
    assert sorted(objects.values()) == [1, 1, 1, 2]
    places = [(r.id, r.member, r.object_id) for r in flat["occurrences"].collect()]
    texts = {bytes(r.child_id): r.scalar for r in flat["texts"].collect()}
    bridges = {(r.object_id, r.ordinal): texts[bytes(r.child_id)] if r.child_id else None for r in flat["bridges"].collect()}
    assert len(places) == 5 and {o for *_, o in places} == set(objects) and len(bridges) == 7 and sorted(texts.values()) == ["", " ", "x"]
    assert sorted(k for i, m, o in places if (i, m) == ("a", "ingredients") for (b, k), text in bridges.items() if b == o and text is not None) == [0, 2]
