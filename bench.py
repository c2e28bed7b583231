"""Times the headline queries and prints one JSON line.

Every query is run once to warm up and then ``BENCH_REPEAT`` times; the median counts.
Results are written to Spark's ``noop`` sink, so that all rows are computed and none
passes through the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from showbill import catalog  # noqa: E402

HEADLINE = (
    "w02_digest", "w01_top_picks", "w03_feed_rank", "w05_next_per_venue", "w05_next_per_person", "w06_rerank_by_taste",
    "g02_zip_pairwise", "g05_all_digests", "a01_group_by_title", "a03_finalize", "a04_venues", "a05_people",
    "a08_derived_rating", "a11_source_health", "a18_person_pages", "a19_reader_showings", "a20_validate",
    "f04_windows", "f07_filter_events", "f10_sparse_policy", "j01_attach_venue", "j05_companions", "j08_refresh_regressions",
    "j09_coverage", "j12_similarity", "p02_normalize_dates", "p20_replace_banned", "p42_standardize", "s09_main_text",
    "s10_schedule_doc", "k03_calendar_rows", "k06_jsonld", "reader_picks", "publish_events",
)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("showbill-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    registry = catalog.load()
    spark = session(cpus)
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
