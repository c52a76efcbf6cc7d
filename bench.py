"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.
Each query runs twice; the faster run counts, written in full to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "T1_filter_truth", "T1_fifty_predicates", "T2_question_truth", "T10_samples_with_truth",
    "P12_count_and_rate", "P13_all_columns", "D4_schema_profile", "D4_low_cardinality_values",
    "X1_summed_tokens", "X4_final_answer_nested", "X4_last_answer_of_turn_table", "X9_kept_attempt",
    "C4_statement_counts", "C5_filter_rows_ok", "C7_numbers_in_documents", "C_all_scores_in_one_pass",
    "R5_accuracy_table", "R12_composite", "R18_error_table", "R19_family_coverage",
    "R20_R21_verdict_table", "R25_volume_with_total", "R26_run_facts", "S7_read_successful_logs",
    "K3_spend_per_model", "M3_missing_cells", "M5_compare_reasoning",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
             # Call sites of columns are for debugging and make plans slow to build.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
