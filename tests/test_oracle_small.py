"""Every registered query against its DuckDB twin on the smallest scale."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, _rows

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = _rows([r.asDict() for r in sdf.collect()], cols)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    drows = _rows([dict(zip(dcols, r)) for r in res.fetchall()], cols)
    assert srows == drows
