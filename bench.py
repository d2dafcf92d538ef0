"""Time the headline queries: prints one JSON line.

Each query runs twice on the same session and the second run counts; results go
to the no-op sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402
from workload.session import local_session  # noqa: E402

HEADLINES = [
    "clean_text_docs", "rating_normalize", "date_normalize", "content_key", "url_list",
    "page_triage", "extract_reviews", "dedup_page_content", "dedup_cross_page",
    "dedup_two_pass", "insert_if_absent", "page_runs", "recap", "progress_running",
    "latest_ten", "product_quality",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    timings = {}
    for name in names:
        timings[name] = round([seconds(spark, name, sf_dir) for _ in range(runs)][-1], 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "review analytics headline queries, wall time of the second run",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
