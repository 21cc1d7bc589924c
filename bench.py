"""Times the headline queries and prints one JSON line: median seconds of three warm runs each, and their sum."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from graphloom.queries import all_queries

HEADLINES = ["cy_flagship", "cy_chain", "cy_varlen_1_3", "cy_not_exists", "sr_degree", "sr_page", "sr_bm25", "gr_bfs_multi", "gr_impact", "gr_schema", "ar_boundaries", "ar_hotspots", "rj_coupling", "rj_resolve", "tx_tokenize", "vs_topk", "vs_idf", "rm_query", "st_p99"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for turn in range(4):  # the first run compiles
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if turn == 0 and runs[0] > 60:
                break
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")} | {"master": f"local[{cpus}]"}}))


if __name__ == "__main__":
    main()
