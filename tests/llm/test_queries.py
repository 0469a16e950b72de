"""Every operator's query against its SQL, and the shape the contracts ask for."""
import pytest

import __spark_entry__ as E
from plantlens.llm import common
from verify import compare, duck

common.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(common.QUERIES))
def test_query(spark, sf, con, name):
    df = common.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) > 0
    if name in common.ORACLES:
        cur = con.execute(common.ORACLES[name])
        orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
        assert compare(df.columns, rows, ocols, orows) == []


def test_entry_offers_the_operators():
    queries, sql = E.queries(), E.oracle_sql()
    assert {"pipeline", *common.QUERIES} <= set(queries)
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14)] == [1] * 13
    assert set(sql) <= set(queries)


@pytest.mark.parametrize("name,table", [("op1_licenses", "documents"), ("op2_minhash_near_dedup", "documents"), ("op4_exact_dedup", "documents"),
                                        ("op5_html_extract", "pages"), ("op6_decontaminate", "documents"), ("op7_substring_dedup", "documents"),
                                        ("op8_byte_bpe", "documents"), ("op13_word_bpe", "documents"), ("op9_toxicity", "documents"), ("op10_url_rules", "pages")])
def test_one_row_per_row_of_the_table(spark, sf, name, table):
    assert common.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
