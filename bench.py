"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of cores. Every query runs
to the end (a no-op sink takes all rows); the session is warmed up first.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from creditloom.session import build_session

HEADLINE = [
    "b11_correlation", "b12_dataset_summary", "c7_quality_rollup", "d10_feature_table", "d11_history_long",
    "e1_stratified_split", "e3_stratified_folds", "f5_best_threshold", "f7_metrics", "g4_top_factors",
    "g5_global_importance", "g6_category_impact", "h3_section_windows", "h5_hashed_vectors", "h7_nearest_vectors",
    "h10_hybrid_route", "h15_title_match", "j1_portfolio_underwriting", "j3_feature_job", "j4_corpus_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("creditloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["b8_rate_by_sex"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
