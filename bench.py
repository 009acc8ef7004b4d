"""Times the catalogue's queries and prints one JSON line.

BENCH_SF_DIR: table folder; BENCH_CPUS: threads; BENCH_QUERIES: names, comma-separated, or "headline"
(default: all);
BENCH_RUNS: timed runs after one warm-up, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptweave.plans import inputs
from scriptweave.plans.catalog import QUERIES
from tests.session import make_session

HEADLINE = [
    "page_lines", "html_paragraphs", "clean_text", "scene_number", "lines_by_person", "speaker_totals",
    "cooccurrence", "cooccurrence_scenes", "line_numbers", "tokenize", "words_by_person_season",
    "sent_score", "sent_polarity", "sent_emotion", "trend_smooth", "distinctive_words",
    "pay_overall_long", "vocab_distinct_length", "main_vs_recurring",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if chosen == "headline" else chosen.split(",") if chosen else list(QUERIES)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = make_session()
    # the bench tables are files of one row group; larger tables need no dealing out
    inputs.PARTITIONS = spark.sparkContext.defaultParallelism
    seconds = {}
    for name in names:
        run(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "catalogue_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
