"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

HEADLINE = ["pricing_summary", "shipping_priority", "local_supplier_revenue", "forecast_revenue", "top_per_group", "cube", "correlated_subquery", "join_sort_merge", "join_as_of", "join_range", "ranks", "tumbling", "sessions", "count_distinct", "exact_duplicates"]


def main() -> None:
    from marlstone.plans.catalog import QUERIES
    from marlstone.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    top = tempfile.mkdtemp(prefix="spark-")
    spark = session(cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.local.dir": top, "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.checkpoint.dir": f"file://{top}/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs[1:])[1], 4)
    print(json.dumps({"metric": "sum of warm medians of the headline queries", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
