"""Benchmark: wall time of the headline queries, one JSON line on stdout.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.  With ``--all``
every registered query is timed; with ``--oracle`` the SQL is timed in DuckDB too.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "aggregated_metrics", "latest_metrics", "system_snapshot", "overall_status", "rules_join_latest",
    "new_alerts_anti", "alert_episodes", "incident_rollup", "availability", "upsert_metrics", "downsample",
    "metric_percentiles", "feature_vector", "histogram_cumulative", "throughput", "promql_instant_asof",
    "promql_rate", "rolling_model_performance", "sequence_windows", "session_events", "late_side_output",
    "tumbling_metrics", "sliding_metrics", "topology_edges", "ensemble_probability", "score_batch",
    "anomaly_stat", "forecast_linear", "select_optimal_model", "rate_limit_sliding", "analyze_logs", "mask_sensitive",
]


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")

    from tidewatch.plans import ORACLES, QUERIES, load_all
    from tidewatch.session import local_session

    load_all()
    spark = local_session(cores)
    keys = list(QUERIES) if "--all" in argv else HEADLINE

    def once(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # one small run so that starting the JVM and the Python workers is not measured
    once("fleet_summary")
    once("mask_sensitive")
    cold = {key: once(key) for key in keys}
    warm = {key: once(key) for key in keys} if "--all" not in argv else cold
    out = {
        "metric": "total wall time of the headline queries (warm)", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cores),
    }
    if "--oracle" in argv:
        from tests.harness import connect

        con = connect(sf_dir)
        con.execute(f"SET threads={cores}")
        timed = {}
        for key in keys:
            if key in ORACLES and "RECURSIVE" not in ORACLES[key]:
                start = time.perf_counter()
                con.execute(f"CREATE OR REPLACE TEMP TABLE __out AS {ORACLES[key]}")
                timed[key] = round(time.perf_counter() - start, 3)
        out["oracle"] = timed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1:])
