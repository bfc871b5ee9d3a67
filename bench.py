"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketloom.plans.queries import QUERIES  # noqa: E402
from ticketloom.session import local_session  # noqa: E402

HEADLINES = [
    "dashboard_summary", "weekly_volume", "recent_tickets", "ticket_severity_priority",
    "ticket_diagnosis", "clean_documents", "duplicate_rows", "low_cardinality_values",
    "articles_from_tickets", "document_terms", "retrieve_topk", "retrieval_evaluation",
    "validate_escalate", "triage_end_to_end", "feedback_applied", "classification_report",
    "stratified_split", "stream_volume",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINES
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
