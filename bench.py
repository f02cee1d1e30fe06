"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line; each is warmed up once, then the median of three runs counts."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tendersieve.queries import QUERIES

HEADLINE = (
    "overview_kpis", "status_funnel", "monthly_volume", "top_bodies", "p75_hot_today", "award_indicators", "trends_weekly", "yoy",
    "tag_cross_region", "body_ranking_modal_kind", "lead_time_median", "failure_rates_grouping_sets", "discount_by_dimension", "market_share", "hhi_by_segment", "rivals_median_discount",
    "pairs_co_award", "opportunity_score", "lateral_latest", "predecessor_asof", "distinct_on_canonical", "term_coverage_rank", "chunks", "average_precision", "anomaly_sigma", "events_session", "cdc_events",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
