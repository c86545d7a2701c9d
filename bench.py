"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query's time is the better of two runs after a warm-up, with all rows written to a sink that drops them. All queries
run once before any runs again, so that each is timed in a JVM that is as warm as for the others. Names that begin with
"native" are plain Spark aggregates of the same column, for comparison.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sketchloom.plans.queries import QUERIES
from sketchloom.sources.tables import table

HEADLINE = ["stats_basic_by_event", "stats_kurtosis", "stats_weighted", "stats_merge_partials", "spacesaving_topk_int", "spacesaving_words", "spacesaving_merge", "topk_exact", "tdigest_quantile_user", "tdigest_large", "tdigest_histogram_user", "tdigest_merge_user", "tdigest_rollup"]
NATIVE = {
    "native_avg": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("m")),
    "native_kurtosis": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.skewness("value").alias("g"), F.kurtosis("value").alias("k")),
    "native_percentile_user": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("q")),
    "native_percentile_approx": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], 10000).alias("q")),
    "native_approx_top_k": lambda s, d: table(s, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).agg(F.expr("approx_top_k(word, 20, 2000)").alias("t")),
}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every = {n: QUERIES[n] for n in HEADLINE} | NATIVE
    times: dict[str, list[float]] = {name: [] for name in every}
    for _ in range(3):
        for name, f in every.items():
            began = time.perf_counter()
            f(spark, d).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - began)
    took = {name: round(min(t[1:]), 3) for name, t in times.items()}
    total = sum(v for k, v in took.items() if not k.startswith("native"))
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": float(d.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()
