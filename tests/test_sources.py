import json
import os

import pytest
from pyspark.errors import AnalysisException

from potflow.operators.graphs import long_form
from potflow.operators.vocabulary import dim_ingredient, dim_operation, vocabulary_block
from potflow.sources import json_io, replay
from potflow.sources.tables import current, dropped, written
from potflow.streaming import verify


def test_corpus(spark, tmp_path):
    rows = [{"id": f"r{i}", "partition": "test" if i % 2 else "train", "title": "t", "ingredients": [{"text": "x", "other": 1}], "instructions": []} for i in range(20)]
    (tmp_path / "layer1.json").write_text(json.dumps(rows))
    corpus = json_io.read_corpus(spark, str(tmp_path / "layer1.json"), "test")
    assert corpus.count() == 10 and corpus.first().ingredients[0].text == "x"
    with pytest.raises(AnalysisException):
        json_io.read_corpus(spark, str(tmp_path / "absent.json")).count()
    json_io.store_corpus(corpus, str(tmp_path / "parquet"))
    assert any("partition=test" in d for d in os.listdir(tmp_path / "parquet"))
    a, b = ({r.id for r in json_io.sampled(corpus.repartition(k), 4).collect()} for k in (1, 7))
    assert a == b and len(a) == 4 and json_io.sampled(corpus, 99).count() == 10
    (tmp_path / "v.json").write_text(json.dumps([{"name": "garlic", "n": 3}, {"verb": "stir"}, {"name": ""}, {"name": "Garlic"}]))
    assert {(r.vocab_key, r.name) for r in json_io.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("garlic", "Garlic"), ("stir", "stir")}
    json_io.write_results(corpus.groupBy("partition").count(), str(tmp_path / "deep" / "out"))
    assert spark.read.json(str(tmp_path / "deep" / "out")).first()["count"] == 10


def test_current_rows(spark, layer1):
    rows = layer1([("A", "old", [], [], 1), ("a ", "new", [], [], 9), ("a", "new", [], [], 9), (None, "x", [], [], 1), ("b", None, None, None, 1)], extra=("_rank",))
    assert {(r.id, r.title) for r in current(rows).collect()} == {("a", "new"), ("b", None)}


def test_json_round_trip(spark, sf):
    r, n, e = long_form(spark, sf)
    recipes, nodes, edges, errors = json_io.graphs_from_json(json_io.graphs_to_json(r, n, e))
    broken = {x.recipe_id for x in errors.collect()}
    assert 0 < len(broken) < 20 and {tuple(x) for x in recipes.collect()} == {tuple(x) for x in r.collect() if x.recipe_id not in broken}
    want = {(x.recipe_id, x.node_id, x.name, x.op_type) for x in n.join(r, "recipe_id", "left_semi").collect() if x.recipe_id not in broken}
    assert {(x.recipe_id, x.node_id, x.ingredient.name if x.ingredient else None, x.operation.op_type if x.operation else None) for x in nodes.collect()} == want
    text = json.loads(json_io.graphs_to_json(r, n, e).where("recipe_id IS NOT NULL").first().json)
    assert list(text) == ["dish_name", "category", "nodes", "edges"]
    lines = json_io.graphs_to_json(r, n, e, indent=True).where("json IS NOT NULL").first().json
    assert "\n" in lines and list(json.loads(lines))[:2] == ["dish_name", "category"]


def test_json_that_gives_no_graph(spark):
    whole = {"dish_name": "d", "category": "soup", "nodes": [{"node_id": "a", "node_type": "ingredient", "ingredient": {"name": "x", "category": "grain"}}, {"node_id": "o", "node_type": "dish_output"}], "edges": [["a", "o"]]}
    node = lambda **x: whole | {"nodes": [{"node_id": "a", "node_type": "operation", "operation": {"op_type": "stir", "params": {"k": [1, {"z": None}]}}} | x]}
    cases = {
        "cut": "{", "list": "[]", "null": None, "absent": '{"nodes": []}', "category": whole | {"category": "cake"}, "nodes": whole | {"nodes": "x"}, "no id": whole | {"nodes": [{"node_type": "dish_output"}]},
        "type": node(node_type="thing"), "payload": node(operation=None), "op": node(operation={"op_type": "juggle"}), "kind": whole | {"nodes": [{"node_id": "a", "node_type": "ingredient", "ingredient": {"name": "x", "category": "stone"}}]},
        "edge": whole | {"edges": [["a"]]}, "good": whole, "params": node(), "twice": whole | {"nodes": [*whole["nodes"], {"node_id": "a", "node_type": "dish_output"}]},
    }
    rows = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in cases.items()], "recipe_id string, json string")
    recipes, nodes, edges, errors = json_io.graphs_from_json(rows)
    assert {x.recipe_id for x in recipes.collect()} == {"good", "params", "twice"}
    found = {x.recipe_id: (x.failure_code, x.failure_detail) for x in errors.collect()}
    assert len(found) == len(cases) - 3 and {k for k, (code, _) in found.items() if code == "json_parse_error"} == {"cut", "list", "null"}
    assert found["absent"][1] == "lacks dish_name, category, edges" and found["category"][1] == "category cake" and found["op"][1] == "unknown op_type"
    read = nodes.collect()
    assert json.loads(next(x.operation.params for x in read if x.recipe_id == "params")) == {"k": [1, {"z": None}]}
    assert [(x.node_seq, x.node_id, x.node_type) for x in read if x.recipe_id == "twice"] == [(0, "a", "dish_output"), (1, "o", "dish_output")] and edges.count() == 3


def test_replay_and_client(spark):
    prompts = spark.createDataFrame([("r1", "p1"), ("r2", "p1"), ("r3", "p3")], "recipe_id string, prompt_hash string")
    recorded = spark.createDataFrame([("p1", "b"), ("p1", "a"), ("p2", "c"), ("p3", None)], "prompt_hash string, raw string")
    assert {(r.recipe_id, r.raw) for r in replay.replayed(prompts, recorded).collect()} == {("r1", "b"), ("r2", "b"), ("r3", None)}
    times = spark.createDataFrame([("p1", "z", "2024-01-01", 1), ("p1", "a", "2024-01-02", 1), ("p1", "b", "2024-01-02", 2), ("p1", "c", None, 9)], "prompt_hash string, raw string, received_at string, attempt int")
    assert {r.raw for r in replay.replayed(prompts.limit(2), times).collect()} == {"b"}
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert replay.with_retries(flaky, "x", 3, 2.0, waits.append) == "ok" and waits == [2.0, 4.0]
    calls.clear()
    assert replay.with_retries(flaky, "x", 2, 1.0, waits.append) is None

    def client():
        return lambda prompt: prompt.upper() if prompt != "bad" else 1 / 0

    rows = replay.asked(spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", None)], "recipe_id string, prompt string"), client, retries=1, pause=0.0)
    assert {(r.recipe_id, r.raw) for r in rows.collect()} == {("a", "X"), ("b", None), ("c", None)}


def test_chat_client(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "answer"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    monkeypatch.delenv("SOME_KEY", raising=False)
    with pytest.raises(ValueError):
        replay.chat_client("http://x", "m", "SOME_KEY")
    monkeypatch.setenv("SOME_KEY", "k")
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = replay.chat_client(f"http://127.0.0.1:{server.server_port}/chat", "m", "SOME_KEY")("system")
    assert call("question") == "answer"
    server.shutdown()
    assert seen[0][0] == "Bearer k" and seen[0][1]["model"] == "m" and seen[0][1]["temperature"] == 0.0 and [m["role"] for m in seen[0][1]["messages"]] == ["system", "user"]


def test_prompts(spark):
    block = vocabulary_block(dim_ingredient(spark), dim_operation(spark)).first().block
    assert block.split("\n")[1] == "  ALLIUM: garlic, onion, scallion, shallot" and block.endswith("ALLOWED CATEGORIES: pasta, eggs, salad, stir_fry, soup")
    assert "  COMBINE: blend, combine, fold, mix, stir, toss, whisk" in block


def test_streams(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/responses.parquet").repartition(3).write.parquet(source)
    ingredients = spark.read.parquet(f"{sf}/dim_ingredient.parquet")
    out = verify.verdict_stream(verify.response_stream(spark, source), ingredients)
    query = out.writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    counts = verify.arrivals(verify.response_stream(spark, source)).writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    from potflow.operators.parsing import parsed_table, response_graphs
    from potflow.operators.rules import verified

    batch = {(r.recipe_id, r.is_valid) for r in verified(response_graphs(parsed_table(spark, sf))).collect()}
    assert len({r.is_valid for r in spark.table("verdicts").collect()}) >= 1 and spark.table("verdicts").count() >= len(batch)
    assert spark.sql("SELECT sum(n) FROM arrivals").first()[0] == spark.read.parquet(source).count()


def test_written_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(5), "x")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]


def test_dropped_removes_only_what_was_written(spark, tmp_path):
    a = written(spark.range(5), "x")
    derived = a.where("id > 1")
    dropped(derived)
    assert a.count() == 5
    dropped(a)
    assert not os.path.exists(a.written_to.toUri().getPath())


def test_no_shared_folder_is_an_error():
    from types import SimpleNamespace

    from potflow.sources.tables import shared_dir

    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
