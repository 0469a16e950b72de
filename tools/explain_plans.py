"""Write the formatted physical plans of the headline queries to docs/PLANS.md.

usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SHOW = ["oee_by_machine", "oee_grouping_sets", "winsorize", "machine_shift_cube", "attach_shift_cluster", "shift_totals_bucketed",
        "distinct_by_period", "stream_episodes"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from plantlens.plans import context as ctx
    from plantlens.plans.registry import QUERIES, load_all
    from plantlens.session import get_spark
    from plantlens.sources.plant import plant_log
    load_all()
    spark = get_spark(master="local[4]", shuffle_partitions=8)
    out = ["# Physical plans of headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf}` (local[4], 8 shuffle partitions, AQE on; "
           "plans before AQE re-optimisation).  Scratch paths are shortened.", ""]

    def add(title, df):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        for name, path in ctx.version(spark, sf).paths.items():
            plan = plan.replace(path, f"<{name}>")
        for g in ctx.generations(spark, sf).parts:
            plan = plan.replace(g.log, "<bronze>")
        lines = [x if len(x) <= 240 else x[:240] + " ..." for x in plan.strip().split("\n")]
        out.extend([f"## {title}", "", "```", *lines, "```", ""])

    add("bronze build: the plant log (lineitem ⋈ orders ⋈ part)", plant_log(spark, sf))
    for name in SHOW:
        add(name, QUERIES[name](spark, sf))
    from plantlens.plans.q_io import enrich
    add("enriched_log, as it is written", enrich(spark, sf).hint("rebalance", F.col("date"), F.col("line_id")))
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
