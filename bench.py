"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from fathomline.plans import QUERIES
from fathomline.session import build_session

HEADLINE = "minute_aggregate state_runs load_cycles trailing_features rule_raw_conditions rule_hold_islands episode_sessions label_instants ticket_match precision_recall cost_ledger cost_by_backend_argmax threshold_sweep vector_topk move_match_score rules_decision series_minmax alarm_hysteresis".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    shared = tempfile.mkdtemp(prefix="spark-bench-")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.checkpoint.dir": f"file://{shared}"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
