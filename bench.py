"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kinfold.plans import catalog  # noqa: E402
from kinfold.session import build_session  # noqa: E402

HEADLINE = [
    "identifiers_extracted", "guest_clusters", "guest_profiles", "resolution_events",
    "review_cases", "golden_profile", "fuzzy_reviews", "timeline_page", "timeline_ended",
    "object_view", "ingest_outcomes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("kinfold-bench", cpus)
    records = spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "records": records,
                "ingest_records_per_sec": round(records / seconds["ingest_outcomes"], 1),
                "events_records_per_sec": round(records / seconds["resolution_events"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
