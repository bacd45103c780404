"""Time the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The derived panel and its universe stand for stored tables: building them is timed on its own (``panel``)
and they are kept.  Every other shared result is dropped before each query, so its time holds all the
work from the panel on.
"""

from __future__ import annotations

import json
import os
import time

from crosspanel import plans
from crosspanel.plans import base
from crosspanel.session import build_session

HEADLINE = (
    "performance",
    "cs_rank",
    "liquidity_decile",
    "distribution",
    "monthly_ic",
    "horizon_stats",
    "persistence",
    "return_model_by_year",
    "ewma_covariance",
    "risk_decomposition",
    "ledger_grid",
    "select_cumulative",
    "scenario_points",
    "policy_beta",
    "mechanisms",
    "inference",
    "score_features",
    "validation_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session(cores, "crosspanel-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    queries["table_status"](spark, sf_dir).collect()  # start the JVM's workers
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    for build in (base.panel, base.universe, base.stats):
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds["panel"] = round(time.perf_counter() - start, 3)
    for name in wanted:
        base.release(keep=("panel", "universe", "month_stats"))
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    base.release()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
