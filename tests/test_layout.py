"""The bucketed layout: a join and a grouping on its keys without an exchange."""
from plantlens.operators import layout as Y
from plantlens.plans import q_layout
from plantlens.plans.registry import QUERIES, load_all

load_all()


def test_no_exchange_of_the_log(spark, sf):
    QUERIES["shift_totals_bucketed"](spark, sf).count()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # else the small labels are broadcast, which proves nothing
    try:
        df = q_layout.joined(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        assert df.count() > 0
    finally:
        spark.conf.set(key, before)


def test_buckets_follow_the_rows():
    assert [Y.buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10**12)] == [8, 8, 16, 2**19]
