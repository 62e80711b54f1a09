import os

import duckdb
import pandas as pd
import pytest

from potflow.llm import queries


def rows(df):
    cell = lambda x: "" if x is None or x is pd.NA or x != x else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_held_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
