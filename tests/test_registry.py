"""Every registered query runs on the small fixture; oracle-checked ones
match their DuckDB restatement (row count, columns, values)."""
import pytest

import __spark_entry__ as E
from plantlens.plans.registry import KIND, ORACLES, QUERIES, load_all
from verify import compare, duck

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        orows = cur.fetchall()
        ocols = [d[0] for d in cur.description]
        assert compare(df.columns, rows, ocols, orows) == []
    else:
        assert KIND[name] == "P"
        assert len(rows) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 4
    assert "oee_norm" in df.columns
