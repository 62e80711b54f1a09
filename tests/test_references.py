from datetime import datetime

import duckdb

from potflow.operators import references


def t(m, d=1):
    return datetime(2024, m, d)


def tables(spark, layer1):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    struct = "struct<name: string, category: string, is_protein: boolean, is_liquid: boolean>"
    return dict(
        layer1=layer1([("A", "x", [], [], 1), (" a", "x", [], [], 5, 20), ("b", "x", [], [], 10), ("c", "x", [], [], 2, 3), (None, "x", [], [], 2)], extra=("ref_key", "period", "t")),
        det_ingrs=one([("a ", None, None, t(1, 25)), ("A", None, None, t(1, 6)), ("b", None, None, t(1, 3)), ("zz", None, None, None), ("zz/1", None, None, None), ("b", None, None, None), (None, None, None, t(1)), ("  ", None, None, t(1))], "id string, ingredients array<struct<text: string>>, valid array<boolean>, loaded_at timestamp_ntz"),
        responses=one([("c", 1, "h", "raw", t(1, 1)), ("c", 2, "h", "raw", t(2, 1)), ("c", 3, "h", "raw", t(1, 2))], "recipe_id string, attempt int, prompt_hash string, raw string, received_at timestamp_ntz"),
        recipes=one([("a", "d", "soup", t(3)), ("q", "d", "soup", t(3))], "recipe_id string, dish_name string, category string, loaded_at timestamp_ntz"),
        nodes=one([("a", "N1", 0, "dish_output", None, None, "s", t(4)), ("a", "n2", 0, "dish_output", None, None, "s", t(4, 9)), ("w", "n1", 0, "dish_output", None, None, "s", None)], f"recipe_id string, node_id string, node_seq int, node_type string, ingredient {struct}, operation struct<op_type: string, params: string>, site string, loaded_at timestamp_ntz"),
        edges=one([("A", "n1", "N2", 0, t(4, 5)), ("a", "n1", None, 1, t(4, 5)), ("a", "n9", " ", 2, t(4, 5)), ("a", "n9", "n1", 3, t(5, 5)), ("a/n1", "x", None, 5, t(4, 5)), ("a", "n1/x", None, 6, t(4, 5)), (None, "n1", "n1", 4, t(5))], "recipe_id string, src string, dst string, edge_seq int, loaded_at timestamp_ntz"),
    )


def test_kinds(spark, layer1, save):
    folder = save(**tables(spark, layer1))
    got = {(r.src_table, r.ref_column, r.ref_key, r.period, r.kind) for r in references.p4_found(spark, folder).collect()}
    assert got == {
        ("det_ingrs", "id", "a", "2024-01", "deleted"),
        ("det_ingrs", "id", "b", "2024-01", "late"),
        ("det_ingrs", "id", "zz", "none", "missing"),
        ("det_ingrs", "id", "zz/1", "none", "missing"),
        ("responses", "recipe_id", "c", "2024-01", "late"),
        ("responses", "recipe_id", "c", "2024-02", "deleted"),
        ("recipes", "recipe_id", "a", "2024-03", "deleted"),
        ("recipes", "recipe_id", "q", "2024-03", "missing"),
        ("nodes", "recipe_id", "w", "none", "missing"),
        ("edges", "dst", "a/n2", "2024-04", "late"),
        ("edges", "src", "a/n9", "2024-04", "missing"),
        ("edges", "src", "a/n9", "2024-05", "missing"),
        ("edges", "src", "a/n1/x", "2024-04", "missing"),
    }
    con = duckdb.connect()
    for name in ("layer1", "det_ingrs", "responses", "recipes", "nodes", "edges"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    assert got == set(con.execute(references.SQL["p4_found"]).fetchall())
    report = {(r.src_table, r.ref_column, r.period, r.kind): (r.n_keys, r.n_rows) for r in references.p4_report(spark, folder).collect()}
    assert report["responses", "recipe_id", "2024-01", "late"] == (1, 2)


def test_empty_tables(spark, layer1, save):
    folder = save(**{k: df.limit(0) for k, df in tables(spark, layer1).items()})
    assert references.p4_found(spark, folder).count() == 0 and references.p4_report(spark, folder).count() == 0
