"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

queries: one pass in order, in which a mart is made by the first query that reads it; anew: each query with all marts dropped before; kept: each with its marts there.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from waymark import catalog
from waymark.proxy import drop_marts

HEADLINE = [
    "flagship_top_units", "ag02_condition_profile", "ag03_reconciliation", "wi02_trailing_means", "cl09_clean_rows", "jo07_orphans", "jo16_parent_child_enrichment", "sp02_within_distance", "sp04_assign",
    "mo06_metric_suite", "bc10_cost_bcr", "po04_summary", "va03_panel", "va07_rederivation",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()

    def seconds(name: str) -> float:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - t, 3)

    took, anew, kept = {name: seconds(name) for name in HEADLINE}, {}, {}
    for name in HEADLINE:
        drop_marts(spark)
        anew[name], kept[name] = seconds(name), seconds(name)
    drop_marts(spark)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "anew": anew, "kept": kept, "sf": sf}))


if __name__ == "__main__":
    main()
