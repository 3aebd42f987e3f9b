"""Times the headline queries and prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from tessera import Catalog, avg, col, count, desc, scan, sum_, to_dataframe
from tessera.__main__ import generated, shapes
from tessera.catalogue import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
ORDERS = 1_000_000


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # a million payments of 1,000 accounts, seeded; in memory as the published figures' inputs are
    made, files = generated(spark, ORDERS, 42, int(CPUS)), Catalog(spark, SF_DIR)
    plans = {f"gen_{name}": (plan, made) for name, plan in shapes().items()} | {
        "file_scan_filter": (scan("lineitem").where(col("l_quantity") > 25.0), files),
        "file_join": (scan("customer", "c").join(scan("orders", "o"), col("c.c_custkey").eq(col("o.o_custkey")), strategy="hash"), files),
        "file_join_sum": (
            scan("customer", "c").join(scan("orders", "o"), col("c.c_custkey").eq(col("o.o_custkey"))).group("c.c_nationkey").agg(sum_(col("o.o_totalprice")), count(), avg(col("o.o_totalprice"))),
            files,
        ),
        "file_sort_desc": (scan("lineitem").sort(desc("l_extendedprice")), files),
    }
    runs = {name: (lambda p=p, c=c: to_dataframe(p, c)) for name, (p, c) in plans.items()}
    runs |= {name: (lambda q=q: q(spark, SF_DIR)) for name, q in queries().items() if name.startswith("pipeline_")}
    times: dict[str, float] = {}
    for name, make in runs.items():
        noop(make())  # warm-up
        found = []
        for _ in range(RUNS):
            t = time.perf_counter()
            noop(make())
            found.append(time.perf_counter() - t)
        times[name] = round(median(found), 4)
    rates = {n: round(ORDERS / times[n]) for n in plans if n.startswith("gen_")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows_per_sec": rates, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
