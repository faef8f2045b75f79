"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is built and run
in full, every row through a no-op sink; the first run of a small query warms the JVM up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "project_to_ground kinematics_sg rule_violations physics_stats pair_distances alert_cooldown crossings od_summary"
    " occupancy_series behaviour_runs lookback_segments clip_buffer extract_triples interaction_edges precedes_edges"
    " search_events classify_intent percentile_floor reprojection_error interaction_speed top_acceleration"
).split()


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    run(spark, "track_lifespan", sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
