"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cautela.session import local_session  # noqa: E402
from workload import views  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "risk_level_counts",
    "full_assessment",
    "rule_hits",
    "url_flags",
    "report_rows",
    "report_counts",
    "sanitised_documents",
    "union_labelled",
    "training_set",
    "manifest",
    "dedup_documents",
    "synthetic_messages",
    "word_tfidf",
    "char_grams",
    "stratified_split_rows",
    "roc_auc",
    "evidence_summary",
    "assessment_with_context",
    "stream_assessments",
    "stream_reports",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("cautela-bench", cpus)
    views.SPREAD = int(cpus)
    # The first query of a JVM pays for class loading and for compiling the rules; this run of it is not timed.
    QUERIES["risk_scores"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
