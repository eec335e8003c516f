"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge import queries
from tallyforge.session import local_session, ship

HEADLINE = ("pass_at_1", "tau_b_variant", "bootstrap_ci", "pairwise_divergence", "tau_by_level", "degrade_rows", "equivalence_verdict", "kill_rate", "bleu1", "bigram_precision", "sbc_score", "completeness", "token_bucket", "cache_miss", "wilcoxon_w")
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = ship(local_session(cpus, "8g"))
    times, cold = {}, {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        cold[name], times[name] = round(took[0], 3), round(median(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "warm seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
