"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from laudospark.plans.catalog import QUERIES
from laudospark.session import build_session

HEADLINE = [
    "exams_by_month",
    "report_results",
    "classify_exam",
    "strip_pii",
    "extract_entities",
    "split_header",
    "patient_data",
    "document_results",
    "strip_pii_documents",
    "kb_term_hits",
    "compound_diagnoses",
    "build_prompt",
    "best_candidate_text",
    "concat_pages",
    "job_current_state",
    "lexical_stats",
    "retrain_set",
    "normalize_case",
]


def run(spark: SparkSession, name: str, sf: str) -> float:
    """Seconds to compute every row and column of a query; nothing is sent to Python."""
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "laudospark-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "laudospark.spreadSmallScans": "true",
            "spark.driver.memory": "16g",
            "spark.driver.host": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first run of a session pays for class loading and compiling; it is reported on its own.
    cold = run(spark, HEADLINE[0], sf)
    times = {name: run(spark, name, sf) for name in HEADLINE}
    report = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cold_first_query": cold,
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
