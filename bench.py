"""Headline queries, timed once each in a warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from watchmere.plans import contract
from watchmere.session import session

HEADLINES = ["search_regex", "stats_count_dc", "top_n", "timechart_1h_by", "first_seen", "threshold_count", "threshold_distinct", "success_after_failures", "sequence_chain", "fingerprint_dedup", "risk_decay", "baseline_host"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    contract.QUERIES["business_hours"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        t = time.perf_counter()
        contract.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
