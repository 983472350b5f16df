"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores, BENCH_RUNS the timed runs of
each query. The first run warms up and is not counted; a result is computed in
full and not kept. ``queries`` holds whole times, ``build`` what of them passes
until the query function returns (plans, and jobs that it runs by itself).
"""

import json
import os
import statistics
import time

from checks.queries import QUERIES
from reviewloom.session import local_session

HEADLINE = [
    "language_counts", "dimension_counts", "summary_report", "rating_stats",
    "top_phrases", "dedup_first", "merge_new", "infer_countries", "detect_languages",
    "extract_json_ld", "extract_embedded_state", "extract_blocks", "extract_cascade",
    "parse_notes", "ingest_pages", "store_documents_stream",
]


def run(spark, name, folder):
    """(seconds in all, seconds until the query function returned)."""
    start = time.time()
    frame = QUERIES[name](spark, folder)
    built = time.time() - start
    frame.write.format("noop").mode("overwrite").save()
    return time.time() - start, built


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times, build = {}, {}
    for name in HEADLINE:
        run(spark, name, folder)
        taken = [run(spark, name, folder) for _ in range(runs)]
        times[name], build[name] = (
            round(statistics.median(t), 3) for t in zip(*taken, strict=True))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build": build, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
