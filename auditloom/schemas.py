"""Column layouts shared by the jobs."""

from __future__ import annotations

FINDING = (
    "repo_id string, src_ord int, pos bigint, tool string, severity string, title string, "
    "description string, file_path string, rule_id string, finding_type string, remediation string"
)
FINDING_COLUMNS = [part.strip().split(" ")[0] for part in FINDING.split(",")]

SCHEMA_FIELD_COLUMNS = [
    "repo_id", "source_file", "model", "model_pos", "field_pos",
    "name", "field_type", "line_number", "comment",
]

WORKFLOW_STEP = (
    "repo_id string, file_path string, wf_name string, job string, step_no bigint, "
    "run string, uses string, env map<string,string>, step_text string"
)

# A report, registry answer or settings export is one JSON text per row.  Items of
# a report get ``pos`` = report number * REPORT_STRIDE + index inside the report.  A text
# of Spark has fewer than 2**31 bytes and an item with the comma behind it three at least,
# so no report runs into the next; a report number beyond 2**33 is an overflow error.
REPORT_STRIDE = 1 << 30
