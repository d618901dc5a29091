"""From the scanners to the report: all nine sources through merge, mapping and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.operators import content, data_fields, governance, infrastructure, merge, mapping, packages, workflows
from auditloom.operators.ordered import in_turn
from auditloom.plans import audit
from auditloom.session import new_folder
from auditloom.sources import reports, store

from . import oracle as O
from . import q_audit, q_content, q_packages, q_repos, q_sources  # noqa: F401 - they register the scanner texts
from .derived import view
from .registry import ORACLES, check

SETTING_ROWS = ["repo_id", "pos", "tool", "severity", "title", "description", "file_path", "rule_id", "finding_type"]


def scanner_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of the nine sources, each made by its own scanner from its own input."""
    settings = governance.settings_findings(q_repos.repos(spark, sf))
    files = view(spark, sf, "d_files")
    file_repos = q_repos._file_repos(spark, sf)
    shared = files.where("page_id % 2 = 0").select(F.left("repo_id", F.lit(1)).alias("owner"), "path")
    required = governance.missing_governance(file_repos, files, shared)
    checked = infrastructure.iac_findings(reports.iac_checks(q_sources._iac_reports(spark, sf)))
    unscanned = infrastructure.iac_unscanned(infrastructure.detected_frameworks(files), file_repos.where("source_type = 'github'"))
    licensed = packages.copyleft_findings(reports.sbom_components(q_packages._sbom_reports(spark, sf)))
    steps = q_repos.steps(spark, sf)
    return merge.merge_findings(
        semgrep=reports.sast_findings(q_sources._sast_reports(spark, sf)),
        osv=packages.vuln_rollup(q_packages.vulns(spark, sf)),
        github=settings.where("tool = 'github'"),
        secrets=content.content_findings(content.content_scan(q_audit.document_texts(spark, sf))),
        governance=in_turn(required.select(*SETTING_ROWS), settings.where("tool = 'governance'").select(*SETTING_ROWS)),
        sbom=packages.sbom_union(licensed, q_packages._unmaintained(spark, sf)),
        iac=in_turn(checked.select(*SETTING_ROWS), unscanned.select(*SETTING_ROWS)),
        cicd=workflows.workflow_findings(steps.select("repo_id", "file_path"), steps),
        data_class=data_fields.model_pii(view(spark, sf, "d_fields")),
    )


def _source(number: int, tool: str, *names: str) -> str:
    """One source in SQL: the texts of its checks, numbered check after check."""
    parts = []
    for part, name in enumerate(names):
        has = lambda column: column if column in COLUMNS_OF.get(name, ()) else "NULL"  # noqa: E731, B023
        parts.append(
            f"SELECT repo_id, {part} AS part, {has('pos')}::bigint AS own, {has('tool')}::varchar AS said, severity, title, "
            f"description, {has('file_path')}::varchar AS file_path, rule_id, {has('finding_type')}::varchar AS finding_type "
            f"FROM ({ORACLES[name]}) x"
        )
    return f"""SELECT repo_id, {number} AS src_ord,
        row_number() OVER (PARTITION BY repo_id ORDER BY part, own, file_path, title, description) - 1 AS pos, '{tool}' AS tool,
        severity, title, description, file_path, rule_id, finding_type, NULL::varchar AS remediation, said
        FROM ({' UNION ALL '.join(parts)}) y"""


#: Which of the optional columns the text of a scanner returns.
COLUMNS_OF = {
    "sast_from_json": ("pos", "tool", "file_path"), "vuln_rollup": ("pos", "tool"), "repo_settings_checks": ("tool", "finding_type"),
    "content_scan_findings": ("pos", "tool", "file_path"), "missing_governance": ("finding_type",),
    "copyleft": ("pos", "finding_type"), "stale_with_cve": ("pos", "finding_type"), "iac_from_json": ("pos", "file_path", "finding_type"),
    "iac_unscanned": ("finding_type",), "env_secrets": ("file_path", "finding_type"), "run_secrets": ("file_path", "finding_type"),
    "missing_sast_gate": ("finding_type",), "unsigned_publish": ("file_path", "finding_type"), "model_pii": ("file_path", "finding_type"),
}
PARTS = [
    _source(0, "semgrep", "sast_from_json"), _source(1, "osv", "vuln_rollup"),
    f"SELECT * FROM ({_source(2, 'github', 'repo_settings_checks')}) z WHERE said = 'github'",
    _source(3, "secrets", "content_scan_findings"),
    f"SELECT * FROM ({_source(4, 'governance', 'missing_governance', 'repo_settings_checks')}) z WHERE coalesce(said, 'governance') = 'governance'",
    _source(5, "sbom", "copyleft", "stale_with_cve"), _source(6, "iac", "iac_from_json", "iac_unscanned"),
    _source(7, "cicd", "env_secrets", "run_secrets", "missing_sast_gate", "unsigned_publish"), _source(8, "data_classification", "model_pii"),
]
SCANNED = "scanned AS MATERIALIZED (SELECT * EXCLUDE (said) FROM (" + " UNION ALL ".join(f"({p})" for p in PARTS) + ") t)"
SCANNED_MAPPED = [SCANNED, O.dedup("scanned", "u"), O.preset_cve("u", "t"), O.classify("t", "c"), O.mapped("c", "m")]
SCANNED_REPORT = [*SCANNED_MAPPED, "all_r AS (SELECT DISTINCT repo_id FROM scanned)", O.scores("m", "all_r", "s"), O.report("s", "all_r")]


@check("audit_from_sources", O.with_(*SCANNED_REPORT) + f" SELECT {q_audit.REPORT_COLUMNS}, {O.SUMMARY} AS executive_summary FROM s_report")
def audit_from_sources(spark, sf):
    """Scanner inputs to one report row per repository."""
    found = scanner_findings(spark, sf)
    return audit.audit_report(found)


@check("report_findings", O.with_(*SCANNED_MAPPED, f"r AS {O.as_values_sql('remediation')}") + """
    SELECT framework, control_id, tool, severity, rule_id, count(*) AS n, count(DISTINCT file_path) AS files,
           count(CASE WHEN coalesce(m.remediation, '') <> '' THEN m.remediation ELSE r.remediation END) AS with_remediation,
           count(DISTINCT explanation) AS explanations
    FROM m LEFT JOIN r ON r.finding_type = m.resolved_type GROUP BY ALL""")
def report_findings(spark, sf):
    """The findings table beside the reports, written by framework and read back, in counts per control and rule."""
    path = new_folder(spark, "findings")
    prepared = audit.prepare_findings(scanner_findings(spark, sf))
    store.write_findings(mapping.mapped_controls(prepared), path)
    table = spark.read.parquet(path)
    return table.groupBy("framework", "control_id", "tool", "severity", "rule_id").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count("remediation").alias("with_remediation"),
        F.count_distinct("explanation").alias("explanations"),
    )
