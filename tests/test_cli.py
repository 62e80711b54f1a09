import json

from pyspark.sql import functions as F

from potflow.__main__ import arguments, coverage
from potflow.operators import evaluation
from potflow.operators.vocabulary import dim_ingredient, dim_operation, system_prompt, user_prompt
from potflow.sources.json_io import read_corpus
from potflow.sources.replay import prompt_hash
from tests.test_parsing import good


def test_arguments():
    a = arguments(["coverage", "--corpus-path", "x", "--responses", "y"])
    assert (a.n, a.partition, a.verbose) == (200, "test", False) and arguments(["recall", "--verbose"]).verbose


def test_coverage_of_a_corpus(spark, tmp_path):
    rows = [{"id": f"r{i}", "partition": "test", "title": f"t{i}", "ingredients": [{"text": "x"}], "instructions": [{"text": "stir"}, {"text": None}]} for i in range(4)]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    corpus = read_corpus(spark, str(tmp_path / "c.json"))
    prompts = corpus.select("id", prompt_hash(user_prompt(F.col("title"), F.col("ingredients.text"), F.array(F.lit("stir")))).alias("h")).collect()
    raw = {"r0": json.dumps(good()), "r1": "{", "r2": json.dumps(good(category="out_of_scope"))}
    responses = spark.createDataFrame([(p.h, raw.get(p.id)) for p in prompts], "prompt_hash string, raw string")
    report = coverage(spark, str(tmp_path / "c.json"), responses, 10, "test")
    assert {r.recipe_id: r.failure_code or r.status for r in report.collect()} == {"r0": "success", "r1": "json_parse_error", "r2": "out_of_scope", "r3": "api_error"}
    assert {r.recipe_id: r.title for r in report.collect()} == {f"r{i}": f"t{i}" for i in range(4)}
    counts = evaluation.counters(report).first()
    document = json.loads(evaluation.summary(report).first().document)
    assert document["n_attempted"] == 4 and document["categories"] == {"soup": 1} and document["violation_counts"] == {} and document["pct_failed"] == 50.0
    assert document["failure_reasons"]["api_error"] == 1 and len(document["failure_reasons"]) == 2 and any(k.startswith("json_parse_error: ") for k in document["failure_reasons"])
    assert (counts.n_attempted, counts.n_valid, counts.pct_failed) == (4, 1, 50.0)


def test_client_gets_system_prompt_where_nothing_is_recorded(spark, tmp_path):
    assert arguments(["coverage", "--corpus-path", "x", "--responses", "y", "--delay", "2"]).delay == 2.0
    text = system_prompt(dim_ingredient(spark), dim_operation(spark)).first().prompt
    assert "ALLOWED INGREDIENTS" in text and '"category": "pasta|eggs|salad|stir_fry|soup|out_of_scope"' in text and "allium|" in text and "\n8. " in text
    answer, recorded = json.dumps(good()), json.dumps(good(category="out_of_scope"))

    def client(system):
        return lambda prompt: answer if system == text and prompt.startswith("TITLE: ") else "{"

    rows = [{"id": f"r{i}", "partition": "test", "title": f"t{i}", "ingredients": [{"text": "x"}], "instructions": [{"text": "stir"}]} for i in range(2)]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    corpus = read_corpus(spark, str(tmp_path / "c.json")).where("id = 'r0'")
    hashes = corpus.select(prompt_hash(user_prompt(F.col("title"), F.col("ingredients.text"), F.col("instructions.text"))).alias("prompt_hash"))
    report = coverage(spark, str(tmp_path / "c.json"), hashes.withColumn("raw", F.lit(recorded)), 10, "test", client, 0.0)
    assert {r.recipe_id: r.failure_code or r.status for r in report.collect()} == {"r0": "out_of_scope", "r1": "success"}
