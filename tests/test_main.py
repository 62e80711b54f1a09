import json

from pyspark.sql import functions as F

from potflow.__main__ import main
from potflow.sources.json_io import read_corpus
from potflow.sources.replay import prompt_hash
from potflow.operators.vocabulary import user_prompt
from tests.test_parsing import good


def test_coverage_writes_rows_and_one_document(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps([{"id": f"r{i}", "partition": "test", "title": f"t{i}", "ingredients": [{"text": "x"}], "instructions": [{"text": "stir"}]} for i in range(3)]))
    corpus = read_corpus(spark, str(tmp_path / "c.json")).where("id != 'r2'")
    hashes = corpus.select(prompt_hash(user_prompt(F.col("title"), F.col("ingredients.text"), F.col("instructions.text"))).alias("prompt_hash"), F.when(F.col("id") == "r0", json.dumps(good())).otherwise("{").alias("raw"))
    hashes.write.parquet(str(tmp_path / "responses"))
    main(["coverage", "--corpus-path", str(tmp_path / "c.json"), "--responses", str(tmp_path / "responses"), "--out", str(tmp_path / "deep" / "out"), "--verbose"])
    document = json.loads(next((tmp_path / "deep" / "out" / "summary").glob("part-*")).read_text())
    assert document["n_attempted"] == 3 and document["categories"] == {"soup": 1} and document["failure_reasons"]["api_error"] == 1
    assert spark.read.json(str(tmp_path / "deep" / "out" / "recipes")).where("title = 't0' AND status = 'success'").count() == 1
    main(["recall", "--verbose"])
    assert "no false positive" in capsys.readouterr().out
