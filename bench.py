"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "meeting_overview", "extract_decisions", "extract_actions", "extract_risks", "link_provenance_lexical",
    "context_window", "drop_small_talk", "weighted_criterion_scores", "summary_coverage", "rouge_1",
    "segments_from_text", "latest_status", "topic_segments", "merge_short_turns", "extract_all",
]


def main() -> None:
    from colloquy.plans.registry import QUERIES
    from colloquy.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.read.parquet(f"{folder}/conversations.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
