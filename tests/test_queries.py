"""Every registered query of the engine against its DuckDB SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from tallyframe.plans import ledger, texts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = ledger.queries() | texts.queries(), ledger.oracle_sql() | texts.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(df):
    columns = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) and not math.isinf(v) and abs(v) < 1e6 else str(v)[:10] if hasattr(v, "year") else v
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(con.execute(SQL[name]).df()) == rows(QUERIES[name](spark, SF).toPandas())


def test_entry_imports():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) >= set(SQL)
