"""Repositories: addresses, settings, workflows, schema fields, files, infrastructure."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.dims import fields as dim_fields, tools
from auditloom.functions import classify as fc, locations, severity as fs
from auditloom.operators import data_fields, governance, infrastructure, workflows
from auditloom.sources import files as src_files, reports

from . import oracle as O
from .derived import view
from .registry import check

# --------------------------------------------------------------------------- addresses

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
SSH_URL = "regexp_matches(url, '^git@([^:]+):([^/]+)/([^/]+)$')"
IDENTITY = f"""{O.inputs("d_repos")},
    parsed AS (SELECT *, {SCHEME} AS scheme, {HOST} AS host, list_filter(string_split(regexp_replace(trim(
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '\\.git$', ''), '/'), lambda p: p <> '') AS parts,
            starts_with(url, 'git@') OR starts_with(url, 'ssh://') AS ssh FROM d_repos),
    kinds AS (SELECT *, CASE WHEN url = '' THEN '' WHEN starts_with(url, 'zip://') THEN 'zip'
        WHEN ssh AND contains(url, 'github.com') THEN 'github' WHEN ssh AND contains(url, 'gitlab.') THEN 'gitlab'
        WHEN ssh AND contains(url, 'bitbucket.org') THEN 'bitbucket' WHEN ssh OR scheme NOT IN ('http', 'https') THEN 'git'
        WHEN contains(host, 'github.com') THEN 'github' WHEN contains(host, 'gitlab') THEN 'gitlab'
        WHEN contains(host, 'bitbucket') THEN 'bitbucket' ELSE 'git' END AS source_type FROM parsed),
    ident AS (SELECT * EXCLUDE (parts),
        CASE WHEN {SSH_URL} THEN regexp_extract(url, '^git@([^:]+):([^/]+)/([^/]+)$', 2)
             WHEN scheme IN ('http', 'https', 'ssh') AND source_type IN ('github', 'gitlab', 'bitbucket') AND len(parts) >= 2 THEN parts[1] END AS owner,
        CASE WHEN {SSH_URL} THEN regexp_replace(regexp_extract(url, '^git@([^:]+):([^/]+)/([^/]+)$', 3), '\\.git$', '')
             WHEN scheme IN ('http', 'https', 'ssh') AND source_type = 'bitbucket' AND len(parts) >= 2 THEN parts[2]
             WHEN scheme IN ('http', 'https', 'ssh') AND source_type IN ('github', 'gitlab') AND len(parts) >= 2 THEN parts[len(parts)]
             WHEN scheme IN ('http', 'https', 'ssh') AND source_type NOT IN ('github', 'gitlab', 'bitbucket') AND len(parts) >= 1 THEN parts[len(parts)]
        END AS repo FROM kinds)"""


def repos(spark, sf):
    """The derived repositories with owner, name and kind of host."""
    return view(spark, sf, "d_repos").withColumn("i", locations.repo_identity(F.col("url"))).select("*", "i.*").drop("i")


@check("repo_identity", O.with_(IDENTITY) + " SELECT repo_id, url, owner, repo, source_type FROM ident")
def repo_identity(spark, sf):
    return repos(spark, sf).select("repo_id", "url", "owner", "repo", "source_type")


@check("cache_key", O.with_(IDENTITY) + """
    SELECT repo_id, CASE WHEN source_type = 'github' AND owner IS NOT NULL AND repo IS NOT NULL AND coalesce(sha, '') <> ''
      THEN owner || '_' || repo || '_' || sha ELSE 'fb_' || md5(url) END AS cache_key FROM ident""")
def cache_key(spark, sf):
    return view(spark, sf, "d_repos").select("repo_id", locations.cache_key(F.col("url"), F.col("sha")).alias("cache_key"))


@check("admit_repos", O.with_(O.inputs("d_repos")) + """
    SELECT repo_id, CASE WHEN starts_with(url, 'zip://') AND NOT has_upload THEN 'ZIP extraction path is missing or invalid.'
      WHEN starts_with(url, 'zip://') OR regexp_matches(url, '^(http://|https://|git@|ssh://)') THEN NULL
      ELSE 'Unrecognized input: ''' || url || '''. Provide a git URL, local path, or upload a ZIP.' END AS error FROM d_repos""")
def admit_repos(spark, sf):
    return view(spark, sf, "d_repos").select(
        "repo_id", locations.admission_error(F.col("url"), F.col("has_upload")).alias("error")
    )


# --------------------------------------------------------------------------- settings

SETTINGS = """
    hosted AS (SELECT * FROM ident WHERE source_type = 'github' AND owner IS NOT NULL AND repo IS NOT NULL),
    sfx AS (SELECT *, CASE WHEN policy_url IS NOT NULL THEN ' (the repo has a security policy at ' || policy_url
        || ', suggesting org-level protections may exist — a GitHub token with admin:org scope is needed to verify)'
        ELSE ' (org-level protections may not be visible without a GitHub token with admin:org scope)' END AS suffix FROM hosted)"""
SETTING_COLUMNS = ["repo_id", "tool", "severity", "title", "description", "rule_id", "finding_type"]


@check("repo_settings_checks", O.with_(IDENTITY, SETTINGS) + """
    SELECT repo_id, 'github' AS tool, 'info' AS severity, 'Repository is public' AS title,
           'Repository is publicly accessible (expected for open-source projects)' AS description, 'github_public_repo' AS rule_id, NULL AS finding_type
    FROM hosted WHERE NOT private UNION ALL
    SELECT repo_id, 'github', 'high', 'Branch protection missing', 'Default branch ''' || default_branch || ''' has no PR review requirements' || suffix,
           'github_branch_protection', NULL FROM sfx WHERE legacy_status = 200 AND NOT required_reviews UNION ALL
    SELECT repo_id, 'github', 'info', 'Branch protection missing', 'Default branch ''' || default_branch || ''' has no detectable protection rules' || suffix,
           'github_branch_protection', NULL FROM sfx WHERE legacy_status <> 200 AND rules_status = 200 AND n_rules = 0 UNION ALL
    SELECT repo_id, 'github', 'info', 'Branch protection status unknown', 'Cannot verify branch protection for ''' || default_branch
           || '''. A GitHub token with appropriate scope is required for accuracy.', 'github_branch_protection', NULL
    FROM sfx WHERE legacy_status <> 200 AND rules_status <> 200 UNION ALL
    SELECT repo_id, 'github', 'high', 'MFA not enforced', 'Organization does not enforce 2FA for members', 'github_mfa', NULL
    FROM hosted WHERE org_2fa = false UNION ALL
    SELECT repo_id, 'governance', 'low', 'Signed commits not enforced', 'Default branch does not require signed commits.',
           'gov_unsigned_commits', 'unsigned_commits' FROM hosted WHERE signatures_enabled = false""")
def repo_settings_checks(spark, sf):
    return governance.settings_findings(repos(spark, sf)).select(*SETTING_COLUMNS)


def _setting_exports(spark, sf):
    r = view(spark, sf, "d_repos")
    answer = lambda status, *body: F.struct(status.alias("status"), F.struct(*body).alias("body"))
    reviews = F.when(F.col("required_reviews"), F.lit('{"count":1}'))
    export = F.struct(
        F.struct("private", "default_branch").alias("repo"),
        F.struct(F.col("policy_url").alias("url")).alias("policy"),
        answer(F.col("legacy_status"), F.from_json(reviews, "count int").alias("required_pull_request_reviews")).alias("protection"),
        F.struct(F.col("rules_status").alias("status"), F.array_repeat(F.struct(F.lit("r").alias("type")), F.col("n_rules")).alias("body")).alias("rules"),
        answer(F.lit(200), F.col("org_2fa").alias("two_factor_requirement_enabled")).alias("org"),
        F.when(F.col("signatures_enabled").isNotNull(), answer(F.lit(200), F.col("signatures_enabled").alias("enabled"))).alias("signatures"),
    )
    return r.select("repo_id", F.to_json(export).alias("export"))


@check("settings_from_json", O.with_(O.inputs("d_repos")) + """
    SELECT repo_id, private, default_branch, policy_url, legacy_status, required_reviews, rules_status, n_rules, org_2fa, signatures_enabled FROM d_repos""")
def settings_from_json(spark, sf):
    return reports.repo_settings(_setting_exports(spark, sf))


# --------------------------------------------------------------------------- workflows

def steps(spark, sf):
    env = F.when(F.col("env_key").isNotNull(), F.create_map("env_key", "env_value")).otherwise(F.create_map().cast("map<string,string>"))
    return view(spark, sf, "d_steps").withColumn("env", env)


LOOKS_SECRET = f"""(env_value <> '' AND NOT starts_with(env_value, '${{{{') AND lower(env_value) NOT IN {O.in_list(tools.HARMLESS_VALUES)}
    AND (length(env_value) >= {tools.MIN_SECRET_LENGTH} OR regexp_matches(env_value, '{tools.SECRET_VALUE_PATTERN}')))"""
CICD_COLUMNS = ["repo_id", "severity", "title", "description", "file_path", "rule_id", "finding_type"]


@check("env_secrets", O.with_(O.inputs("d_steps")) + f"""
    SELECT repo_id, 'critical' AS severity, 'Plaintext secret in env: ' || env_key AS title,
           'Workflow ''' || wf_name || ''' step sets env var ''' || env_key || ''' to a hardcoded value. Use ${{{{ secrets.' || env_key
           || ' }}}} instead of embedding the value directly in the YAML.' AS description, file_path,
           'cicd_secret_' || lower(env_key) AS rule_id, 'cicd_plaintext_secret' AS finding_type
    FROM d_steps WHERE env_key IS NOT NULL AND {LOOKS_SECRET}""".replace("}}}}", "}}").replace("{{{{", "{{"))
def env_secrets(spark, sf):
    return workflows.plaintext_env_secrets(steps(spark, sf)).select(*CICD_COLUMNS)


@check("run_secrets", O.with_(O.inputs("d_steps")) + """
    , h AS (SELECT *, unnest(regexp_extract_all(run, '""" + tools.SECRET_VALUE_PATTERN + """')) AS hit FROM d_steps)
    SELECT repo_id, 'critical' AS severity, 'Plaintext secret in run step' AS title,
           'Workflow ''' || wf_name || ''' has a hardcoded secret pattern in a run: block (' || left(hit, 12)
           || '...). Use ${{ secrets.NAME }} instead.' AS description, file_path, 'cicd_secret_in_run' AS rule_id,
           'cicd_plaintext_secret' AS finding_type FROM h""")
def run_secrets(spark, sf):
    return workflows.inline_run_secrets(steps(spark, sf)).select(*CICD_COLUMNS)


STEP_TEXT = "lower(concat_ws(' ', run, uses, env_key, env_value, job))"


@check("missing_sast_gate", O.with_(O.inputs("d_steps")) + f"""
    SELECT repo_id, 'low' AS severity, 'No SAST gate in CI/CD' AS title, 'None of the ' || count(DISTINCT file_path)
           || ' workflow files in this repository include a SAST or security scanning step. Consider adding CodeQL, Semgrep, or Snyk to pull request workflows.' AS description,
           CAST(NULL AS VARCHAR) AS file_path, 'cicd_missing_sast_gate' AS rule_id, 'missing_sast_gate' AS finding_type
    FROM d_steps GROUP BY repo_id HAVING NOT bool_or({O.any_contains(STEP_TEXT, tools.SAST_TOOLS)})""")
def missing_sast_gate(spark, sf):
    s = steps(spark, sf)
    return workflows.missing_sast_gate(s.select("repo_id", "file_path"), s).select(*CICD_COLUMNS)


RUN_TEXT = "lower(coalesce(run, '') || ' ' || coalesce(uses, ''))"


@check("unsigned_publish", O.with_(O.inputs("d_steps")) + f"""
    , flags AS (SELECT *, {O.any_contains(RUN_TEXT, tools.SIGNING_WORDS)} AS sgn, {O.any_contains(RUN_TEXT, tools.PUBLISH_COMMANDS)} AS pub FROM d_steps),
    seen AS (SELECT *, max(CASE WHEN sgn THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, file_path ORDER BY step_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM flags)
    SELECT repo_id, 'medium' AS severity, 'Unsigned artifact publish' AS title, 'Workflow ''' || wf_name
           || ''' publishes artifacts without a preceding signing step (cosign, GPG, provenance). Consumers cannot verify the integrity of the artifact.' AS description,
           file_path, 'cicd_unsigned_publish' AS rule_id, 'unsigned_artifact_publish' AS finding_type
    FROM seen WHERE pub AND NOT sgn AND coalesce(before, 0) = 0""")
def unsigned_publish(spark, sf):
    return workflows.unsigned_publish(steps(spark, sf)).select(*CICD_COLUMNS)


# --------------------------------------------------------------------------- schema fields

def _matches(words) -> str:
    ws = O.sql_list(words)
    return f"(list_has_any(string_split(lower(name), '_'), {ws}) OR lower(name) IN {O.in_list(words)})"


PII = f"""{O.inputs("d_fields")},
    flags AS (SELECT *, {_matches(dim_fields.DIRECT_IDENTIFIERS)} AS direct, lower(name) IN {O.in_list(dim_fields.WEAK_IDENTIFIERS)} AS weak,
        {_matches(dim_fields.SENSITIVE_KEYWORDS)} AS sens, {_matches(dim_fields.IDENTITY_DOCUMENTS)} AS doc,
        regexp_matches(lower(name || ' ' || field_type || ' ' || comment), '{"|".join(dim_fields.ENCRYPTION_SIGNALS)}') AS enc FROM d_fields),
    base AS (SELECT repo_id, source_file, model, bool_or(direct AND NOT weak) AS d0, bool_or(sens) AS s0, bool_or(enc) AS e0,
        bool_or(direct AND weak) AS w0 FROM flags GROUP BY 1, 2, 3),
    named AS (SELECT f.repo_id, f.source_file, f.model, string_agg(DISTINCT f.name, ', ' ORDER BY f.name) AS names, bool_or(f.doc) AS docs
        FROM flags f JOIN base b USING (repo_id, source_file, model)
        WHERE (f.direct OR f.sens) AND (NOT f.weak OR b.d0 OR b.s0) GROUP BY 1, 2, 3),
    m AS (SELECT n.*, b.s0, b.e0, b.d0 OR (b.w0 AND (b.d0 OR b.s0)) AS has_direct FROM named n JOIN base b USING (repo_id, source_file, model))"""
FIELD_COLUMNS = ["repo_id", "severity", "title", "description", "file_path", "rule_id", "finding_type"]


@check("model_pii", O.with_(PII) + """
    SELECT repo_id, 'high' AS severity, 'Sensitive category data: ' || model AS title, 'Model ''' || model || ''' in ' || source_file
           || ' contains special-category data fields: ' || names || '. GDPR Art. 9 / DPDP Rule 4 require additional safeguards for this data even if encrypted.' AS description,
           source_file AS file_path, 'dc_sensitive_' || lower(model) AS rule_id, 'sensitive_category_data_detected' AS finding_type FROM m WHERE s0 UNION ALL
    SELECT repo_id, CASE WHEN docs THEN 'high' ELSE 'medium' END, 'Unencrypted PII fields: ' || model, 'Model ''' || model || ''' in ' || source_file
           || ' has PII field(s) (' || names || ') with no detected encryption signal. Consider column-level encryption for these fields.',
           source_file, 'dc_unencrypted_' || lower(model), 'pii_field_unencrypted' FROM m WHERE has_direct AND NOT e0""")
def model_pii(spark, sf):
    return data_fields.model_pii(view(spark, sf, "d_fields")).select(*FIELD_COLUMNS)


@check("first_model", O.with_(O.inputs("d_fields"), """
    p AS (SELECT * REPLACE (field_pos % 3 AS model_pos) FROM d_fields)""") + """
    SELECT repo_id, source_file, model, model_pos, field_pos, name FROM (
        SELECT *, min(model_pos) OVER (PARTITION BY repo_id, source_file, model) AS first FROM p) WHERE model_pos = first""")
def first_model(spark, sf):
    repeated = view(spark, sf, "d_fields").withColumn("model_pos", F.col("field_pos") % 3)
    return data_fields.first_model(repeated).select("repo_id", "source_file", "model", "model_pos", "field_pos", "name")


# --------------------------------------------------------------------------- files

def _file_repos(spark, sf):
    """Hosts of the pages as repositories; the owner is the first letter of the host."""
    return view(spark, sf, "d_files").select("repo_id").distinct().select(
        "repo_id", F.left("repo_id", F.lit(1)).alias("owner"),
        F.when(F.length("repo_id") % 2 == 0, "github").otherwise("gitlab").alias("source_type"),
    )


FILE_REPOS = f"""{O.inputs("d_files")},
    reps AS (SELECT DISTINCT repo_id, left(repo_id, 1) AS owner, CASE WHEN length(repo_id) % 2 = 0 THEN 'github' ELSE 'gitlab' END AS source_type FROM d_files)"""
REQUIRED_SQL = O.values_list(governance.REQUIRED, "required, severity, title, description, rule_id, finding_type")


@check("missing_governance", O.with_(FILE_REPOS) + f"""
    SELECT r.repo_id, q.severity, q.title, q.description, q.rule_id, q.finding_type FROM reps r, {REQUIRED_SQL} q
    WHERE NOT EXISTS (SELECT 1 FROM d_files f WHERE f.repo_id = r.repo_id AND f.path IN (q.required, '.github/' || q.required))
      AND NOT (r.source_type = 'github' AND EXISTS (SELECT 1 FROM d_files f
          WHERE left(f.repo_id, 1) = r.owner AND f.page_id % 2 = 0 AND f.path IN (q.required, '.github/' || q.required)))""")
def missing_governance(spark, sf):
    files = view(spark, sf, "d_files")
    shared = files.where("page_id % 2 = 0").select(F.left("repo_id", F.lit(1)).alias("owner"), "path")
    return governance.missing_governance(_file_repos(spark, sf), files, shared).select(
        "repo_id", "severity", "title", "description", "rule_id", "finding_type"
    )


@check("governance_profile", O.with_(O.inputs("d_files")) + """
    SELECT repo_id, bool_or(path IN ('LICENSE', 'LICENSE.md')) AS has_license, bool_or(path = 'CONTRIBUTING.md') AS has_contributing,
           bool_or(path IN ('.github/dependabot.yml', '.github/dependabot.yaml', 'renovate.json', '.renovaterc')) AS has_dependabot
    FROM d_files GROUP BY 1""")
def governance_profile(spark, sf):
    return governance.governance_profile(view(spark, sf, "d_files"))


IAC = f"""
    named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM d_files
        WHERE len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {O.in_list(tools.IAC_SKIP_DIRS)})) = 0),
    det AS (SELECT DISTINCT repo_id, CASE WHEN regexp_matches(name, '(?i)\\.tf(\\.json)?$') THEN 'Terraform'
        WHEN regexp_matches(lower(name), '\\.ya?ml$') AND regexp_matches(path, '(cloudformation|template)/|AWSTemplateFormatVersion') THEN 'CloudFormation'
        WHEN regexp_matches(lower(name), '\\.ya?ml$') AND regexp_matches(content, '(?m)^apiVersion:|^kind:\\s*({"|".join(tools.KUBERNETES_KINDS)})\\s*$') THEN 'Kubernetes'
        WHEN upper(name) = 'DOCKERFILE' OR starts_with(name, 'Dockerfile') THEN 'Dockerfile' END AS fw FROM named)"""


@check("iac_frameworks", O.with_(O.inputs("d_files"), IAC) + """
    SELECT repo_id, string_agg(fw, ',' ORDER BY fw) AS frameworks FROM det WHERE fw IS NOT NULL GROUP BY 1""")
def iac_frameworks(spark, sf):
    return infrastructure.iac_frameworks(view(spark, sf, "d_files")).withColumn("frameworks", F.array_join("frameworks", ","))


@check("iac_unscanned", O.with_(FILE_REPOS, IAC) + """
    SELECT d.repo_id, 'info' AS severity, 'IaC detected: ' || fw AS title, 'IaC framework ''' || fw
           || ''' detected in repository. Install checkov (pip install checkov) to enable configuration scanning.' AS description,
           'checkov_missing_' || lower(fw) AS rule_id, 'iac_storage_misconfigured' AS finding_type
    FROM det d WHERE fw IS NOT NULL AND fw <> 'Dockerfile' AND d.repo_id NOT IN (SELECT repo_id FROM reps WHERE source_type = 'github')""")
def iac_unscanned(spark, sf):
    scanned = _file_repos(spark, sf).where("source_type = 'github'")
    return infrastructure.iac_unscanned(infrastructure.detected_frameworks(view(spark, sf, "d_files")), scanned).select(
        "repo_id", "severity", "title", "description", "rule_id", "finding_type"
    )


@check("iac_scan_skipped", O.with_(FILE_REPOS, IAC) + """
    SELECT r.repo_id, NOT EXISTS (SELECT 1 FROM det d WHERE d.repo_id = r.repo_id AND d.fw IS NOT NULL) AS iac_scan_skipped FROM reps r""")
def iac_scan_skipped(spark, sf):
    detected = infrastructure.detected_frameworks(view(spark, sf, "d_files"))
    return infrastructure.scan_skipped(_file_repos(spark, sf).select("repo_id"), detected)


SCHEMA_RULES = O.values_list([(i, *row) for i, row in enumerate(tools.SCHEMA_FILES)], "n, kind, txt, parser")


@check("schema_files", O.with_(O.inputs("d_files"), f"""
    named AS (SELECT repo_id, path, page_id, lower(regexp_extract(path, '[^/]*$')) AS name FROM d_files
        WHERE len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {O.in_list(tools.SCHEMA_SKIP_DIRS)})) = 0),
    hit AS (SELECT f.repo_id, f.path, f.page_id, arg_min(s.parser, s.n) AS parser FROM named f JOIN {SCHEMA_RULES} s
        ON (s.kind = 'exact' AND f.name = s.txt) OR (s.kind = 'suffix' AND ends_with(f.name, s.txt)) GROUP BY 1, 2, 3),
    pr AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY len(string_split(path, '/')), path) AS k
        FROM (SELECT DISTINCT repo_id, path FROM hit WHERE parser = 'prisma'))""") + """
    SELECT repo_id, path, page_id, parser FROM hit WHERE parser <> 'prisma'
       OR (repo_id, path) IN (SELECT (repo_id, path) FROM pr WHERE k = 1)""")
def schema_files(spark, sf):
    return src_files.classify_schema_files(view(spark, sf, "d_files").drop("content")).select("repo_id", "path", "page_id", "parser")
