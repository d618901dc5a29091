"""Times the headline queries: one JSON line on standard output.

Each query is run once cold and then three times; the median of the three is
reported.  Results are written to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = [
    "audit_report", "content_scan_counts", "dedup_by_rule", "classify_findings", "mapped_controls",
    "framework_scores", "vuln_rollup", "osv_from_json", "sast_from_json", "stale_with_cve", "copyleft",
    "model_pii", "schema_fields_prisma", "schema_fields_python_orm", "unsigned_publish", "missing_governance",
    "iac_frameworks", "regulation_chunks", "match_chunks", "upsert_latest", "node_status", "burst_counts",
    "rate_decisions",
]

#: Timed once cold and once warm, and not part of the total.
MORE = ["audit_from_sources", "rules_as_table", "stale_with_cve_substring", "released_audits"]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session()
    times, cold = {}, {}
    for name in HEADLINE:
        cold[name] = round(run(spark, sf_dir, name), 3)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(repeats)), 3)
        print(f"{name}: cold {cold[name]} s, median {times[name]} s", file=sys.stderr, flush=True)
    more = {}
    for name in MORE:
        run(spark, sf_dir, name)
        more[name] = round(run(spark, sf_dir, name), 3)
        print(f"{name}: warm {more[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries (median of warm runs)",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "more": more,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
