"""Every training-data query with SQL against DuckDB, on the driver's smallest tables."""

import os

import pandas as pd
import pytest

llm = pytest.importorskip("panelmill.llm.queries")
pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 9) for v in row) for row in df[sorted(df.columns)].astype(object).to_numpy().tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    got, want = llm.QUERIES[name](spark, SF).toPandas(), con.execute(llm.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
