"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   parquet folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma separated names (default: the headline list), or `all`
BENCH_RUNS     timed runs per query after one warm-up (default 3); the median counts

Every run builds the query anew, so work done while a plan is built is in the time.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tillroll.operators.ordering import drop_session_tables  # noqa: E402
from tillroll.plans import queries_models, registry  # noqa: E402

HEADLINE = (
    "country_performance", "daily_sales", "product_performance", "customer_analysis",
    "monthly_trends", "processing_summary", "overview", "kpi", "customers_filtered", "alerts",
    "rfm_segment_summary", "high_value_customers", "churn_labels", "rolling_stats",
    "decompose_stats", "sequences", "ab_ttest", "ab_mann_whitney", "ab_bootstrap_ci",
    "sequential_test", "segment_pairwise_ttest", "transaction_chunks", "cosine_topk",
    "kmeans_segments", "forecast_models", "customer_product_factors",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = registry.queries()
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillroll-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tillroll-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            queries_models.forget()
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            drop_session_tables(spark)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{times[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
