"""Every query that has an SQL twin, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from isohyet.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_twin(name, spark, duck):
    a, b = Q.QUERIES[name](spark, DATA).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert set(a.columns) == set(b.columns) and len(a) == len(b) > 0
    keys = sorted(a.columns, key=lambda c: (str(a[c].dtype).startswith("float"), c))
    a, b = (x[keys].sort_values(keys).reset_index(drop=True) for x in (a, b))
    for c in keys:
        if str(a[c].dtype).startswith("float"):
            assert ((a[c] - b[c].astype(float)).abs().fillna(0) <= 2e-6 * a[c].abs().fillna(0).clip(lower=1)).all(), c
            assert (a[c].isna() == b[c].isna()).all(), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(name, spark):
    assert len(Q.QUERIES[name](spark, DATA).toPandas()) > 0
