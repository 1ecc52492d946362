"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from splitframe.plans import catalogue

from . import test_plain

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    clean = [tuple(None if pd.isna(v) else (round(v, 9) + 0.0 if isinstance(v, float) else v) for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return list(pdf.columns), sorted(clean, key=str)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in test_plain.PLAIN  # compared there
        return
    assert rows(got.toPandas()) == rows(db.execute(sql).df())
