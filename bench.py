"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from furlong.session import local_session  # noqa: E402
from furlong.verify.registry import QUERIES  # noqa: E402

HEADLINE = [
    "json_blob_scan", "upsert_latest", "class_grade", "star_view", "course_lookup", "bet_stats", "column_missingness",
    "norm_prob", "odds_rank", "market_entropy", "expanding_rate", "entity_career", "rolling_form", "past10_panel",
    "range_180d", "race_gate", "psi_drift", "row_quality", "score_races", "bet_candidates", "column_profile",
    "page_fields", "feature_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, int(cpus))
    # start the executors and the Parquet reader outside the measured time
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        if sys.stderr.isatty() or os.environ.get("BENCH_VERBOSE"):
            print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
