"""Every registered query of the core against its DuckDB statement."""

import duckdb
import pandas as pd
import pytest

from juncture import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def norm(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(int(v)) if isinstance(v, float) and float(v).is_integer() else str(v)

    return sorted(tuple(map(norm, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(duck.execute(queries.SQL[name]).df())
    else:
        assert len(got)
