"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sightline.plans import QUERIES  # noqa: E402
from sightline.session import get_session  # noqa: E402

HEADLINE = [
    "sightings_fold", "sightings_merge", "metadata_latest", "rotating_dedupe", "payload_ingest",
    "job_fold", "attempt_numbers", "claim_due", "retry_lookup", "negative_cache",
    "request_response", "rate_limit", "search_page", "search_relevance", "search_total",
    "detail_join", "magnet_links", "dir_tree", "metric_series", "metric_current",
    "metric_history", "metric_rates", "series_align", "stats_row", "stage_funnel", "xor_knn",
    "bucket_retention", "anchor_argmax", "top3", "classify_cascade", "llm_parse", "eval_summary",
    "stratified_split", "stream_sightings", "stream_job_fold",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g"),
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {}
    for name in only:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
