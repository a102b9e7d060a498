"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidewright.plans import registry

HEADLINE = ["c9_score", "c12_relevance", "v1_active_pipeline", "v3_keyword_mastery", "v4_weekly_summary", "q1_metrics", "q2_agenda", "q3_pipeline", "q7_recent_questions", "q17_scraped_jobs", "q18_scraped_stats", "q19_source_breakdown", "q25_category_counts", "r7_correlation", "k6_insert_or_ignore", "d2_orphans"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["v4_weekly_summary"](spark, sf_dir).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 4)
    print(json.dumps({"metric": "total of the headline queries, best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
