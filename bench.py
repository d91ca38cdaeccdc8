"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablewright.operators import anomaly, charts, clean, cluster, profile, quality, roles, transform
from tablewright.operators import reduce as reduction
from tablewright.plans import training
from tablewright.plans.cleaning import CleanOptions
from tablewright.plans.cleaning import clean as clean_table

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def table(name):
        return spark.read.parquet(f"{FOLDER}/{name}.parquet")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    lineitem, orders, events, part = table("lineitem"), table("orders"), table("events"), table("part")
    ruled = orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 50).alias("team"),
        F.floor(F.col("o_totalprice") / 10_000).alias("slot"),
        F.when(F.col("o_totalprice") > 250_000, "large").otherwise(F.col("o_orderstatus")).alias("kind"),
    )
    queries = {
        "d0_column_profile": lambda: run(profile.column_profile(lineitem)),
        "d1_numeric_summary": lambda: run(profile.numeric_summary(lineitem)),
        "d5_describe": lambda: run(profile.describe(lineitem)),
        "d7_duplicate_rows": lambda: run(profile.duplicate_rows(lineitem)),
        "d9_correlation": lambda: run(profile.correlation(lineitem)),
        "d11_iqr_outliers": lambda: run(profile.iqr_outliers(lineitem)),
        "d21_simple_report": lambda: run(quality.simple_report(orders)),
        "t1_roles": lambda: run(roles.column_roles(lineitem)),
        "c7_remove_outliers": lambda: run(clean.remove_outliers(lineitem)),
        "c9_clean_table": lambda: run(clean_table(orders, CleanOptions(outliers="remove"))),
        "c13_forward_fill": lambda: run(clean.forward_fill(events, "user_id", "event_id", ["event_type", "value"])),
        "c2_fill_mean": lambda: run(clean.fill_mean(events)),
        "d20_quality_findings": lambda: run(quality.findings(orders)),
        "r5_dictionary_encode": lambda: run(reduction.dictionary_encode(orders, "o_orderkey")),
        "x1_zscore": lambda: run(transform.zscore(lineitem)),
        "x2_equal_width_bins": lambda: run(transform.bin_equal_width(lineitem)),
        "x4_aggregate": lambda: run(transform.aggregate_by_first_text(lineitem)),
        "x5_hierarchy": lambda: run(transform.frequency_hierarchy(part)),
        "r2_pca": lambda: run(reduction.pca(lineitem)),
        "r3_stratified_sample": lambda: run(reduction.stratified_sample(orders, "o_orderpriority", ["o_orderkey"])),
        "v3_histogram": lambda: run(charts.histogram(lineitem, "l_extendedprice")),
        "v11_word_counts": lambda: run(charts.word_counts(table("conversations"), "text")),
        "m4_decision_tree": lambda: run(
            training.train(ruled, "kind", "o_orderkey", ["team", "slot"], "decision_tree", cross_validation=False).scored
        ),
        "m5_random_forest": lambda: run(
            training.train(ruled, "kind", "o_orderkey", ["team", "slot"], "random_forest", cross_validation=False).scored
        ),
        "m27_dbscan": lambda: run(
            cluster.dbscan(orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], "o_orderkey", 0.05)
        ),
        "m29_isolation_forest": lambda: run(
            anomaly.isolation_forest(orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], "o_orderkey")
        ),
    }
    seconds = {}
    lineitem.limit(1).count()  # start the session before the first measurement
    for name, fn in queries.items():
        start = time.perf_counter()
        fn()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
