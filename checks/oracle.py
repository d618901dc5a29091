"""Building blocks of the DuckDB texts the checked queries are compared with.

They state the rules relationally (rule table joined and the smallest priority
taken, window ranks, distinct keys), not the way the jobs compute them.
"""

from __future__ import annotations

from auditloom.dims import as_values_sql, controls, privacy, rules, sql_literal, tools, values_sql
from auditloom.functions.severity import FRAMEWORK_WEIGHT, SEVERITIES, SEVERITY_RANK, SEVERITY_WEIGHT

from . import derived

FRAMEWORKS = controls.FRAMEWORKS


def in_list(values) -> str:
    return "(" + ", ".join(sql_literal(v) for v in values) + ")"


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_literal(w)})" for w in words) + ")"


def mapping_case(expr: str, mapping: dict, default) -> str:
    whens = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {sql_literal(default)} END"


RANK = mapping_case("coalesce(severity, 'low')", SEVERITY_RANK, 0)
WEIGHT = mapping_case("lower(severity)", SEVERITY_WEIGHT, 0)


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def dedup(source: str, name: str = "f_unique") -> str:
    return f"""
    {name}_k AS (SELECT *, CASE WHEN coalesce(rule_id, '') <> '' THEN rule_id
                   ELSE 'finding_' || src_ord || '_' || pos END AS dedup_key, {RANK} AS rank FROM {source}),
    {name} AS (SELECT * EXCLUDE (rank, rn, src_ord, pos), first_place.s AS src_ord, first_place.p AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, dedup_key ORDER BY rank DESC, src_ord, pos) AS rn,
               min(struct_pack(s := src_ord, p := pos)) OVER (PARTITION BY repo_id, dedup_key) AS first_place
        FROM {name}_k) WHERE rn = 1)"""


def cve_case(text: str) -> str:
    def hit(words):
        plain = [w for w in words if w not in rules.CVE_WHOLE_WORDS]
        tests = [f"contains({text}, {sql_literal(w)})" for w in plain]
        tests += [f"regexp_matches({text}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in words if w in rules.CVE_WHOLE_WORDS]
        return "(" + " OR ".join(tests) + ")"

    data, network = hit(rules.CVE_DATA_WORDS), hit(rules.CVE_NETWORK_WORDS)
    return f"""CASE WHEN {hit(rules.CVE_EMAIL_WORDS)} THEN 'dependency_cve_email'
        WHEN {hit(rules.CVE_DOS_WORDS)} AND NOT {data} AND NOT {network} THEN 'dependency_cve_dos'
        WHEN {data} THEN 'dependency_cve_data' WHEN {network} THEN 'dependency_cve_network'
        ELSE 'dependency_cve_dos' END"""


def preset_cve(source: str, name: str) -> str:
    return f"""
    {name} AS (SELECT * REPLACE (CASE WHEN tool = 'osv' AND coalesce(description, '') <> '' AND coalesce(rule_id, '') <> ''
        THEN {cve_case("lower(description)")} ELSE finding_type END AS finding_type) FROM {source})"""


def classify(source: str, name: str) -> str:
    """Adds resolved_type: smallest priority over the rule table."""
    return f"""
    {name}_rules AS {as_values_sql("class_rules")},
    {name}_ids AS (SELECT DISTINCT rule_id, description FROM {source}),
    {name}_hits AS (
        SELECT i.rule_id, i.description, arg_min(r.finding_type, r.prio) AS by_rule
        FROM {name}_ids i JOIN {name}_rules r ON
            (r.kind = 'exact' AND {strip("lower(coalesce(i.rule_id, ''))")} = r.needle)
            OR (r.kind = 'contains' AND contains({strip("lower(coalesce(i.rule_id, ''))")}, r.needle))
            OR (r.kind = 'prefix' AND starts_with({strip("lower(coalesce(i.rule_id, ''))")}, r.needle)
                AND (len(r.desc_needles) = 0 OR len(list_filter(r.desc_needles,
                     lambda w: contains(lower(coalesce(i.description, '')), w))) > 0))
        GROUP BY 1, 2),
    {name} AS (
        SELECT f.*, CASE WHEN coalesce(f.finding_type, '') <> '' THEN f.finding_type
                         ELSE coalesce(h.by_rule, '{controls.DEFAULT_TYPE}') END AS resolved_type
        FROM {source} f LEFT JOIN {name}_hits h
          ON f.rule_id IS NOT DISTINCT FROM h.rule_id AND f.description IS NOT DISTINCT FROM h.description)"""


def mapped(source: str, name: str) -> str:
    """All mapped rows (finding columns + framework, control_id, control_name, explanation)."""
    entries = [(i, list(words), gdpr is not None) for i, (words, gdpr, _) in enumerate(privacy.CURATED)]
    return f"""
    {name}_map AS {as_values_sql("control_map")},
    {name}_cur AS {as_values_sql("curated")},
    {name}_words AS (SELECT entry, personal, unnest(words) AS word FROM {values_sql(entries, "entry, words, personal")}),
    {name}_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY finding_type, framework ORDER BY
               CASE WHEN framework IN ('gdpr', 'dpdp') THEN ord ELSE -ord END) AS pick FROM {name}_map),
    {name}_pick AS (SELECT * FROM {name}_ranked WHERE pick = 1
        AND NOT (framework IN ('gdpr', 'dpdp') AND finding_type IN {in_list(controls.PRIVACY_EXCLUDED_TYPES)})),
    {name}_texts AS (SELECT DISTINCT lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d FROM {source}),
    {name}_first AS (
        SELECT x.t, x.d, min(w.entry) AS entry FROM {name}_texts x JOIN {name}_words w
          ON contains(x.t, w.word) OR contains(x.d, w.word) GROUP BY 1, 2),
    {name}_f AS (
        SELECT f.*, CASE WHEN coalesce(f.rule_id, '') IN {in_list(privacy.GOVERNANCE_RULE_IDS)} THEN -1
                         WHEN coalesce(f.finding_type, '') <> '' THEN NULL ELSE e.entry END AS entry,
               CASE WHEN f.resolved_type IN (SELECT finding_type FROM {name}_map) THEN f.resolved_type
                    ELSE '{controls.DEFAULT_TYPE}' END AS known
        FROM {source} f LEFT JOIN {name}_first e
          ON e.t = lower(coalesce(f.title, '')) AND e.d = lower(coalesce(f.description, ''))),
    {name} AS (
        SELECT f.*, p.framework, p.control_id, p.control_name,
               'Finding ''' || coalesce(f.title, '') || ''' falls under ' || p.control_name || ' (' || p.control_id || ').' AS explanation
        FROM {name}_f f JOIN {name}_pick p ON p.finding_type = f.known WHERE p.framework IN ('soc2', 'iso27001')
        UNION ALL
        SELECT f.*, c.framework, c.control_id, c.control_name, c.explanation
        FROM {name}_f f JOIN {name}_cur c ON c.entry = f.entry
        UNION ALL
        SELECT f.*, p.framework, p.control_id, p.control_name,
               'Finding ''' || coalesce(f.title, '') || ''' relates to ' || p.control_name || ' (' || p.control_id
               || ') as it involves processing of personal data.'
        FROM {name}_f f JOIN {name}_pick p ON p.finding_type = f.known
        WHERE f.entry IS NULL AND p.framework IN ('gdpr', 'dpdp')
          AND f.resolved_type NOT IN {in_list(controls.PRIVACY_EXCLUDED_TYPES)})"""


FINDING_KEY = "coalesce(tool, ''), CASE WHEN coalesce(rule_id, '') <> '' THEN rule_id ELSE coalesce(title, '') END, coalesce(description, '')"


def scores(source: str, repos: str, name: str) -> str:
    """Per-framework scores and the breakdown per repo."""
    counts = ", ".join(f"count(*) FILTER (lower(severity) = '{s}') AS {s}" for s in SEVERITIES)
    return f"""
    {name}_grid AS (SELECT r.repo_id, w.framework FROM {repos} r, {values_sql([(f,) for f in FRAMEWORKS], "framework").replace("AS t(", "AS w(")}),
    {name}_fw_first AS (
        SELECT *, row_number() OVER (PARTITION BY repo_id, framework, {FINDING_KEY} ORDER BY src_ord, pos) AS k FROM {source}),
    {name}_fw AS (
        SELECT g.repo_id, g.framework, CAST(greatest(0, 100 + coalesce(sum({WEIGHT}), 0)) AS INTEGER) AS score
        FROM {name}_grid g LEFT JOIN {name}_fw_first m ON m.repo_id = g.repo_id AND m.framework = g.framework AND m.k = 1
        GROUP BY 1, 2),
    {name}_sum AS (
        SELECT g.repo_id, g.framework, count(m.repo_id) AS findings, count(DISTINCT m.control_id) AS controls_triggered
        FROM {name}_grid g LEFT JOIN {source} m ON m.repo_id = g.repo_id AND m.framework = g.framework GROUP BY 1, 2),
    {name}_all_first AS (
        SELECT *, row_number() OVER (PARTITION BY repo_id, {FINDING_KEY} ORDER BY src_ord, pos) AS k FROM {source}),
    {name}_sev AS (SELECT repo_id, {counts} FROM {name}_all_first WHERE k = 1 GROUP BY 1),
    {name}_wide AS (
        SELECT repo_id, {", ".join(f"max(CASE WHEN framework = '{f}' THEN score END) AS {f}" for f in FRAMEWORKS)}
        FROM {name}_fw GROUP BY 1),
    {name}_overall AS (SELECT *, CAST(round_even({" + ".join(
        f"CAST({FRAMEWORK_WEIGHT[f]} AS DOUBLE) * CAST({f} AS DOUBLE)" for f in FRAMEWORKS)}, 0) AS INTEGER) AS overall_score
        FROM {name}_wide)"""


def report(name: str, repos: str) -> str:
    """Full report rows from the parts of ``scores``."""
    pivot = lambda col, pre: ", ".join(
        f"max(CASE WHEN framework = '{f}' THEN {col} END) AS {pre}_{f}" for f in FRAMEWORKS
    )
    sev = ", ".join(f"coalesce(v.{s}, 0) AS {s}" for s in SEVERITIES)
    total = " + ".join(f"coalesce(v.{s}, 0)" for s in SEVERITIES)
    return f"""
    {name}_pivot AS (SELECT repo_id, {pivot("findings", "findings")}, {pivot("controls_triggered", "controls")} FROM {name}_sum GROUP BY 1),
    {name}_report AS (
        SELECT r.repo_id, o.overall_score, {", ".join(f"o.{f} AS score_{f}" for f in FRAMEWORKS)}, {sev},
               {total} AS total_findings, {", ".join(f"p.findings_{f}" for f in FRAMEWORKS)},
               {", ".join(f"CAST(p.controls_{f} AS INTEGER) AS controls_{f}" for f in FRAMEWORKS)}
        FROM {repos} r JOIN {name}_overall o USING (repo_id) JOIN {name}_pivot p USING (repo_id)
        LEFT JOIN {name}_sev v USING (repo_id))"""


SUMMARY = (
    "'Overall compliance score is ' || overall_score || '/100 (SOC2=' || score_soc2 || ', ISO27001=' || score_iso27001 "
    "|| ', GDPR=' || score_gdpr || ', DPDP=' || score_dpdp || '). ' || total_findings || ' unique findings: ' || critical "
    "|| ' critical, ' || high || ' high, ' || medium || ' medium, ' || low || ' low, ' || info || ' info. "
    "Controls triggered: SOC2=' || controls_soc2 || ', ISO27001=' || controls_iso27001 || ', GDPR=' || controls_gdpr "
    "|| ', DPDP=' || controls_dpdp || '.'"
)


def content_hits(name: str) -> str:
    """(doc_id, source, rule_id, severity, title, n) of the text patterns."""
    parts = []
    for rule_id, severity, title, _, pattern in tools.CONTENT_PATTERNS:
        parts.append(
            f"SELECT doc_id, source, {sql_literal(rule_id)} AS rule_id, {sql_literal(severity)} AS severity, "
            f"{sql_literal(title)} AS title, len(regexp_extract_all(text, {sql_literal(pattern)})) AS n FROM documents"
        )
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def inputs(*names: str) -> str:
    return derived.cte(*names)


def sql_list(values) -> str:
    return sql_literal(list(values))


def values_list(rows, columns: str) -> str:
    """Rows as a derived table to be named by the query."""
    return f"(SELECT * FROM {values_sql(rows, columns)})"
