"""Findings to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.dims import as_df, controls, tools
from auditloom.functions import classify as fc, locations, severity as fs
from auditloom.functions.severity import SEVERITIES
from auditloom.operators import content, mapping, merge, scoring
from auditloom.plans import audit
from auditloom.session import new_folder
from auditloom.sources import report_files as sink, reports, store

from . import oracle as O
from .derived import dealt, view
from .registry import check


# --------------------------------------------------------------------------- flagship

def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = dealt(view(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("pos"), path.alias("path"), "text")


def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the derived repositories and of the document scan."""
    scanned = content.content_findings(content.content_scan(document_texts(spark, sf)))
    return merge.as_findings(view(spark, sf, "d_findings")).unionByName(merge.as_findings(scanned, "secrets"))


def all_repos(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "d_findings").select("repo_id")
    return ids.unionByName(view(spark, sf, "documents").select(F.col("source").alias("repo_id"))).distinct()


ALL_FINDINGS = [
    O.inputs("d_findings"),
    O.content_hits("hits"),
    """all_f AS (
        SELECT repo_id, src_ord, pos, tool, severity, title, description, file_path, rule_id, finding_type, remediation FROM d_findings
        UNION ALL
        SELECT source, 3, doc_id, 'secrets', severity, title,
               title || ' found ' || n || ' time(s) in docs/' || doc_id || '.txt', 'docs/' || doc_id || '.txt', rule_id, NULL, NULL
        FROM hits)""",
    "all_r AS (SELECT repo_id FROM d_findings UNION SELECT source FROM documents)",
]
MAPPED_ALL = [*ALL_FINDINGS, O.dedup("all_f", "u"), O.preset_cve("u", "t"), O.classify("t", "c"), O.mapped("c", "m")]
REPORT_COLUMNS = (
    "repo_id, overall_score, " + ", ".join(f"score_{f}" for f in controls.FRAMEWORKS) + ", " + ", ".join(SEVERITIES)
    + ", total_findings, " + ", ".join(f"findings_{f}" for f in controls.FRAMEWORKS) + ", "
    + ", ".join(f"controls_{f}" for f in controls.FRAMEWORKS)
)
REPORT = [*MAPPED_ALL, O.scores("m", "all_r", "s"), O.report("s", "all_r")]


@check("audit_report", O.with_(*REPORT) + f" SELECT {REPORT_COLUMNS}, {O.SUMMARY} AS executive_summary FROM s_report")
def audit_report(spark, sf):
    return audit.audit_report(all_findings(spark, sf), all_repos(spark, sf))


@check("audit_of_admitted_repos", O.with_(
    *MAPPED_ALL, O.inputs("d_repos"), O.scores("m", "d_repos", "s"), O.report("s", "d_repos"), """
    adm AS (SELECT repo_id, CASE WHEN starts_with(url, 'zip://') AND NOT has_upload THEN 'ZIP extraction path is missing or invalid.'
      WHEN starts_with(url, 'zip://') OR regexp_matches(url, '^(http://|https://|git@|ssh://)') THEN NULL
      ELSE 'Unrecognized input: \'\'' || url || '\'\'. Provide a git URL, local path, or upload a ZIP.' END AS error FROM d_repos)""".replace("\\'", "'")) + f"""
    SELECT r.repo_id, a.error, CASE WHEN a.error IS NULL THEN overall_score ELSE 0 END AS overall_score,
           CASE WHEN a.error IS NULL THEN score_gdpr ELSE 0 END AS score_gdpr, CASE WHEN a.error IS NULL THEN critical ELSE 0 END AS critical,
           CASE WHEN a.error IS NULL THEN controls_soc2 ELSE 0 END AS controls_soc2,
           CASE WHEN a.error IS NULL THEN {O.SUMMARY} ELSE 'Audit could not be completed due to errors.' END AS executive_summary
    FROM s_report r JOIN adm a ON a.repo_id = r.repo_id""")
def audit_of_admitted_repos(spark, sf):
    """Reports of the listed repositories; those that cannot be admitted have a report of zeros."""
    repos = view(spark, sf, "d_repos").select(
        "repo_id", locations.admission_error(F.col("url"), F.col("has_upload")).alias("error")
    )
    return audit.audit_report(all_findings(spark, sf), repos).select(
        "repo_id", "error", "overall_score", "score_gdpr", "critical", "controls_soc2", "executive_summary"
    )


# --------------------------------------------------------------------------- steps of the audit

def unique_findings(spark, sf):
    return merge.dedup_by_rule(merge.as_findings(view(spark, sf, "d_findings")))


def typed_findings(spark, sf):
    return mapping.classify(mapping.preset_cve_types(unique_findings(spark, sf)))


def mapped_rows(spark, sf):
    return mapping.mapped_controls(typed_findings(spark, sf))


def finding_repos(spark, sf):
    return view(spark, sf, "d_findings").select("repo_id").distinct()


UNIQUE = [O.inputs("d_findings"), O.dedup("d_findings", "u")]
TYPED = [*UNIQUE, O.preset_cve("u", "t"), O.classify("t", "c")]
MAPPED = [*TYPED, O.mapped("c", "m")]
SCORED = [*MAPPED, "reps AS (SELECT DISTINCT repo_id FROM d_findings)", O.scores("m", "reps", "s")]
FINDING_ID = "repo_id, src_ord, pos, tool, severity, rule_id"


@check("dedup_by_rule", O.with_(*UNIQUE) + f" SELECT {FINDING_ID}, title, dedup_key FROM u")
def dedup_by_rule(spark, sf):
    return unique_findings(spark, sf).select(*FINDING_ID.split(", "), "title", "dedup_key")


@check("classify_findings", O.with_(*TYPED) + f" SELECT {FINDING_ID}, finding_type, resolved_type FROM c")
def classify_findings(spark, sf):
    return typed_findings(spark, sf).select(*FINDING_ID.split(", "), "finding_type", "resolved_type")


@check("rules_as_table", O.with_(O.inputs("d_findings"), O.classify("d_findings", "c"))
       + f" SELECT {FINDING_ID}, resolved_type FROM c")
def rules_as_table(spark, sf):
    found = merge.as_findings(view(spark, sf, "d_findings"))
    typed = mapping.classify_by_table(found, as_df(spark, "class_rules"))
    return typed.select(*FINDING_ID.split(", "), "resolved_type")


@check("map_controls", O.with_(*TYPED, f"""
    k AS {O.as_values_sql("control_map")},
    x AS (SELECT c.*, k.ord, k.framework, k.control_id, k.control_name FROM c JOIN k ON k.finding_type =
          CASE WHEN c.resolved_type IN (SELECT finding_type FROM k) THEN c.resolved_type ELSE 'dependency_cve_network' END
          WHERE NOT (k.framework IN ('gdpr', 'dpdp') AND c.resolved_type IN {O.in_list(controls.PRIVACY_EXCLUDED_TYPES)}))""")
       + " SELECT repo_id, src_ord, pos, resolved_type, ord, framework, control_id, control_name FROM x")
def map_controls(spark, sf):
    return mapping.map_controls(typed_findings(spark, sf)).select(
        "repo_id", "src_ord", "pos", "resolved_type", "ord", "framework", "control_id", "control_name"
    )


@check("pick_control", O.with_(*TYPED, f"""
    k AS {O.as_values_sql("control_map")},
    p AS (SELECT finding_type, framework, CASE WHEN framework IN ('gdpr', 'dpdp') THEN arg_min(control_id, ord) ELSE arg_max(control_id, ord) END AS control_id,
                 CASE WHEN framework IN ('gdpr', 'dpdp') THEN arg_min(control_name, ord) ELSE arg_max(control_name, ord) END AS control_name
          FROM k WHERE NOT (framework IN ('gdpr', 'dpdp') AND finding_type IN {O.in_list(controls.PRIVACY_EXCLUDED_TYPES)}) GROUP BY 1, 2)""") + """
    SELECT c.repo_id, c.src_ord, c.pos, p.framework, p.control_id, p.control_name FROM c JOIN p ON p.finding_type =
    CASE WHEN c.resolved_type IN (SELECT finding_type FROM k) THEN c.resolved_type ELSE 'dependency_cve_network' END""")
def pick_control(spark, sf):
    """The control of each finding per framework: the last for SOC 2 and ISO 27001, the first for GDPR and DPDP."""
    chosen = mapping.pick_control(as_df(spark, "control_map")).withColumnRenamed("finding_type", "_known")
    found = typed_findings(spark, sf).withColumn("_known", fc.known_type(F.col("resolved_type")))
    return found.join(F.broadcast(chosen), "_known").select(
        "repo_id", "src_ord", "pos", "framework", "control_id", "control_name"
    )


@check("remediation", O.with_(*TYPED, f"r AS {O.as_values_sql('remediation')}") + """
    SELECT c.repo_id, c.src_ord, c.pos, c.resolved_type,
           CASE WHEN coalesce(c.remediation, '') <> '' THEN c.remediation ELSE r.remediation END AS remediation
    FROM c LEFT JOIN r ON r.finding_type = c.resolved_type""")
def remediation(spark, sf):
    return mapping.add_remediation(typed_findings(spark, sf)).select(
        "repo_id", "src_ord", "pos", "resolved_type", "remediation"
    )


PRIVACY_COLUMNS = "repo_id, src_ord, pos, framework, control_id, control_name, explanation"


@check("curated_privacy", O.with_(*MAPPED) + f" SELECT {PRIVACY_COLUMNS} FROM m WHERE entry >= 0 AND framework IN ('gdpr', 'dpdp')")
def curated_privacy(spark, sf):
    return mapping.curated_privacy(typed_findings(spark, sf)).select(*PRIVACY_COLUMNS.split(", "))


@check("fallback_privacy", O.with_(*MAPPED) + f" SELECT {PRIVACY_COLUMNS} FROM m WHERE entry IS NULL AND framework IN ('gdpr', 'dpdp')")
def fallback_privacy(spark, sf):
    return mapping.fallback_privacy(typed_findings(spark, sf)).select(*PRIVACY_COLUMNS.split(", "))


@check("privacy_union", O.with_(*MAPPED) + f" SELECT {PRIVACY_COLUMNS} FROM m WHERE framework IN ('gdpr', 'dpdp')")
def privacy_union(spark, sf):
    return mapping.map_privacy(typed_findings(spark, sf)).select(*PRIVACY_COLUMNS.split(", "))


@check("mapped_controls", O.with_(*MAPPED) + f" SELECT {PRIVACY_COLUMNS} FROM m")
def mapped_controls(spark, sf):
    return mapped_rows(spark, sf).select(*PRIVACY_COLUMNS.split(", "))


@check("privacy_flag", O.with_(*MAPPED, "g AS (SELECT DISTINCT repo_id, src_ord, pos FROM m WHERE framework = 'gdpr')") + """
    SELECT c.repo_id, c.src_ord, c.pos, c.rule_id,
           CASE WHEN coalesce(c.finding_type, '') <> '' THEN c.finding_type ELSE 'unset' END AS raw_type,
           c.resolved_type, g.pos IS NOT NULL AS has_gdpr
    FROM c LEFT JOIN g ON g.repo_id = c.repo_id AND g.src_ord = c.src_ord AND g.pos = c.pos""")
def privacy_flag(spark, sf):
    return mapping.privacy_flag(typed_findings(spark, sf))


@check("severity_breakdown", O.with_(*SCORED) + " SELECT * FROM s_sev")
def severity_breakdown(spark, sf):
    return scoring.severity_breakdown(mapped_rows(spark, sf))


@check("framework_scores", O.with_(*SCORED) + " SELECT * FROM s_fw")
def framework_scores(spark, sf):
    return scoring.framework_scores(mapped_rows(spark, sf), finding_repos(spark, sf))


@check("overall_score", O.with_(*SCORED) + " SELECT * FROM s_overall")
def overall_score(spark, sf):
    return scoring.overall_score(scoring.framework_scores(mapped_rows(spark, sf), finding_repos(spark, sf)))


@check("framework_summary", O.with_(*SCORED) + " SELECT * FROM s_sum")
def framework_summary(spark, sf):
    return scoring.framework_summary(mapped_rows(spark, sf), finding_repos(spark, sf))


@check("summary_text", O.with_(*SCORED, O.report("s", "reps")) + f" SELECT repo_id, {O.SUMMARY} AS executive_summary FROM s_report")
def summary_text(spark, sf):
    found = merge.as_findings(view(spark, sf, "d_findings"))
    return audit.audit_report(found).select("repo_id", "executive_summary")


@check("explanations", O.with_(*MAPPED, """
    e AS (SELECT DISTINCT rule_id, 'Written for ' || rule_id || '.' AS txt FROM d_findings
          WHERE coalesce(rule_id, '') <> '' AND length(rule_id) % 2 = 0)""") + """
    SELECT m.repo_id, m.src_ord, m.pos, m.framework, m.control_id, coalesce(e.txt, m.explanation) AS explanation
    FROM m LEFT JOIN e ON e.rule_id = m.rule_id AND m.framework = 'soc2'""")
def explanations(spark, sf):
    written = view(spark, sf, "d_findings").where("rule_id <> '' and length(rule_id) % 2 = 0").select(
        "rule_id", F.lit("soc2").alias("framework"),
        F.concat(F.lit("Written for "), "rule_id", F.lit(".")).alias("explanation"),
    ).distinct()
    return mapping.attach_explanations(mapped_rows(spark, sf), written).select(
        "repo_id", "src_ord", "pos", "framework", "control_id", "explanation"
    )


@check("explain", O.with_(*MAPPED) + """
    SELECT repo_id, src_ord, pos, framework, control_id, upper(framework) || ' ' || control_id || ': ' || title AS explanation FROM m""")
def explain(spark, sf):
    """Writer hook, with a writer that only fills in a form."""

    def write(items):
        return [f"{i['framework'].upper()} {i['control_id']}: {i['title']}" for i in items]

    return mapping.explain(mapped_rows(spark, sf), write).select(
        "repo_id", "src_ord", "pos", "framework", "control_id", "explanation"
    )


@check("normalize_paths", O.with_(O.inputs("d_findings")) + """
    SELECT repo_id, pos, file_path, ltrim(regexp_replace(regexp_replace(replace(file_path, chr(92), '/'),
        '^/tmp/tmp[^/]+/', ''), '^.*?/Temp/tmp[^/]+/', ''), '/') AS clean_path FROM d_findings""")
def normalize_paths(spark, sf):
    return view(spark, sf, "d_findings").select(
        "repo_id", "pos", "file_path", locations.normalize_path(F.col("file_path")).alias("clean_path")
    )


# --------------------------------------------------------------------------- merging

def _as_records(spark, sf):
    """Nine sources as JSON lines; every 50th line is damaged or no object."""
    found = view(spark, sf, "d_findings")
    damaged = F.when(F.col("pos") % 100 == 0, F.lit("not json")).when(F.col("pos") % 50 == 0, F.lit("[1, 2]"))
    body = F.to_json(F.struct("tool", "severity", "title", "description", "file_path", "rule_id", "finding_type"))
    return found.select("repo_id", "tool", "src_ord", "pos", F.coalesce(damaged, body).alias("record"))


SOURCE_NAMES = [(i, name) for i, (name, _) in enumerate(tools.SOURCES)]


@check("merge_findings", O.with_(O.inputs("d_findings")) + """
    SELECT src_ord, count(*) AS n, count(DISTINCT repo_id) AS repos, count(rule_id) AS with_rule,
           CAST(sum(pos) AS BIGINT) AS pos_sum
    FROM d_findings WHERE pos % 50 <> 0 GROUP BY 1""")
def merge_findings(spark, sf):
    good, _ = reports.quarantine(_as_records(spark, sf).withColumnRenamed("tool", "source"))
    merged = merge.merge_findings(**{name: good.where(F.col("src_ord") == i) for i, name in SOURCE_NAMES})
    return merged.groupBy("src_ord").agg(
        F.count("*").alias("n"), F.count_distinct("repo_id").alias("repos"), F.count("rule_id").alias("with_rule"),
        F.sum("pos").alias("pos_sum"),
    )


@check("quarantine", O.with_(O.inputs("d_findings")) + """
    SELECT src_ord, count(*) FILTER (pos % 50 <> 0) AS accepted, count(*) FILTER (pos % 50 = 0) AS rejected
    FROM d_findings GROUP BY 1""")
def quarantine(spark, sf):
    good, bad = reports.quarantine(_as_records(spark, sf).withColumnRenamed("tool", "source"))
    both = good.select("src_ord", F.lit(1).alias("g")).unionByName(bad.select("src_ord", F.lit(0).alias("g")))
    return both.groupBy("src_ord").agg(
        F.count_if(F.col("g") == 1).alias("accepted"), F.count_if(F.col("g") == 0).alias("rejected")
    )


# --------------------------------------------------------------------------- report sink

@check("report_files", O.with_(*REPORT) + """ SELECT repo_id, overall_score, score_gdpr AS gdpr, high FROM s_report""")
def report_files(spark, sf):
    """Reports written as one document per repository, twice, and read back."""
    path = new_folder(spark, "report-files")
    rows = audit.report_document(audit.audit_report(all_findings(spark, sf), all_repos(spark, sf)))
    sink.write_report_files(rows.limit(3), path)
    sink.write_report_files(rows, path)
    schema = "overall_score int, framework_scores map<string,int>, severity_breakdown map<string,bigint>"
    read = sink.read_report_files(spark, path).select("repo_id", F.from_json("report", schema).alias("r"))
    return read.select("repo_id", "r.overall_score", F.col("r.framework_scores.gdpr").alias("gdpr"), F.col("r.severity_breakdown.high").alias("high"))


@check("report_json", O.with_(*REPORT) + f""" SELECT repo_id, overall_score, {O.SUMMARY} AS executive_summary,
    score_soc2 AS soc2, score_dpdp AS dpdp, high, controls_iso27001 AS iso_controls, findings_gdpr AS gdpr_findings FROM s_report""")
def report_json(spark, sf):
    """Reports written as JSON lines and read back."""
    path = new_folder(spark, "reports")
    rows = audit.audit_report(all_findings(spark, sf), all_repos(spark, sf))
    store.write_reports(audit.report_document(rows), path)
    schema = (
        "repo_id string, overall_score int, executive_summary string, framework_scores map<string,int>, "
        "severity_breakdown map<string,bigint>, frameworks struct<iso27001 struct<controls_triggered int, findings bigint>, "
        "gdpr struct<controls_triggered int, findings bigint>>"
    )
    return spark.read.schema(schema).json(path).select(
        "repo_id", "overall_score", "executive_summary",
        F.col("framework_scores.soc2").alias("soc2"), F.col("framework_scores.dpdp").alias("dpdp"),
        F.col("severity_breakdown.high").alias("high"),
        F.col("frameworks.iso27001.controls_triggered").alias("iso_controls"),
        F.col("frameworks.gdpr.findings").alias("gdpr_findings"),
    )
