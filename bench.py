"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; one JSON line."""

from __future__ import annotations

import json
import os
import time

from chargeaudit.plans.queries import QUERIES
from chargeaudit.session import local_session

HEADLINE = (
    "overcharge_summary",
    "catalog_build",
    "exact_lookup",
    "lookup_coverage",
    "price_overcharge",
    "duplicate_charge",
    "unbundled_pairs",
    "summary_bill_info",
    "detect_anomalies",
    "bill_summary",
    "letter_body",
    "redact_text",
    "leak_gate",
    "candidate_codes",
    "assemble_pages",
    "knn_search",
    "upcoding",
    "description_match",
    "parse_findings",
    "throttle_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", **{"spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").count()  # start the session before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "charge audit queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "lookup_codes_per_sec": round(lines / seconds["exact_lookup"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
