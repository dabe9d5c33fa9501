"""Every registered query against its DuckDB oracle on the smallest tables (the driver repeats
this at sf0.01); queries without SQL must at least run and return rows."""

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import canon
from vulnsift.plans import REGISTRY
from vulnsift.sources.tables import TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    df = q.fn(spark, SF_SMALL)
    rows = df.collect()
    if q.sql is None:
        assert len(rows) > 0
        return
    res = con.execute(q.sql)
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, res.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
