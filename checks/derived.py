"""Inputs of the checked queries, derived from the given tables.

The test data has no security reports, so each input is a view over a given
table.  One SQL text serves both engines: in it ``@name`` stands for a given
table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditloom.dims import values_sql

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# source number, tool, rule id, title, description, stated type
FINDINGS = [
    (0, "semgrep", "dockerfile.security.missing-user", "Missing user", "Container runs as root", None),
    (0, "semgrep", "python.lang.security.audit.hardcoded-password", "Hardcoded password", "A password literal is compiled in", None),
    (0, "semgrep", "python.lang.security.audit.sqli", "Query built by hand", "String concatenation reaches the database query", None),
    (0, "semgrep", "javascript.express.security.xss", "Unescaped output", "Cross-site scripting in a template", None),
    (0, "semgrep", "java.lang.security.use-md5", "Weak digest", "MD5 is used for a checksum", None),
    (0, "semgrep", "generic.no-auth-over-http", "Login over HTTP", "Credentials are sent in clear", None),
    (0, "semgrep", "python.lang.security.audit.exec", "Dynamic execution", "Remote code may run", None),
    (0, "semgrep", "kubernetes.nodes.limit", "Node limit", "Nodes have no limit", None),
    (0, "semgrep", "completely.unknown.rule", "Unknown rule", "Nothing specific", None),
    (0, "semgrep", "javascript.samesite.cookie", "Cookie flag", "Session cookie lacks a flag", None),
    (0, "semgrep", "python.flask.open-redirect", "Redirect", "User input decides where to go", None),
    (0, "semgrep", "", "Untitled rule", "A finding without rule id", None),
    (0, "semgrep", None, "Another untitled rule", "Also without rule id; touches a log file", None),
    (1, "osv", "osv_nodemailer", "nodemailer: 2 known vulnerabilities", "nodemailer has 2 known CVEs: CVE-1, CVE-2. Includes: header injection", None),
    (1, "osv", "GHSA-aaaa-bbbb", "GHSA-aaaa-bbbb", "Denial of service by a crafted pattern", None),
    (1, "osv", "osv_express", "express: 3 known vulnerabilities", "express has 3 known CVEs. Includes: open redirect in routing", None),
    (1, "osv", "osv_sequelize", "sequelize: 2 known vulnerabilities", "sequelize has 2 known CVEs. Includes: auth bypass in the database layer", None),
    (1, "osv", "osv_leftpad", "leftpad: 2 known vulnerabilities", "", None),
    (2, "github", "github_public_repo", "Repository is public", "Repository is publicly accessible", None),
    (2, "github", "github_branch_protection", "Branch protection missing", "Default branch has no review requirements", None),
    (2, "github", "github_mfa", "MFA not enforced", "Organization does not enforce 2FA for members", None),
    (3, "secrets", "pii_phone", "Phone number in source", "A phone number occurs in a fixture", None),
    (3, "secrets", "gitleaks_aws-token", "Cloud key", "A cloud access key occurs in source", None),
    (3, "secrets", "gitleaks_jwt", "Web token", "A signed web token occurs in source", None),
    (4, "governance", "gov_missing_security_policy", "Security policy missing", "No SECURITY.md found", "missing_security_policy"),
    (4, "governance", "gov_missing_codeowners", "CODEOWNERS file missing", "No CODEOWNERS file found", "missing_codeowners"),
    (5, "sbom", "sbom_copyleft_readline", "Copyleft license: gpl-3.0", "Dependency uses a copyleft license", "copyleft_license_risk"),
    (5, "sbom", "sbom_unmaintained_moment", "Unmaintained + CVE: moment", "Dependency has not been updated", "unmaintained_dependency"),
    (6, "iac", "checkov_CKV_AWS_20", "IaC: CKV_AWS_20", "Bucket allows public read", "iac_storage_misconfigured"),
    (6, "iac", "checkov_CKV_DOCKER_3", "IaC: CKV_DOCKER_3", "A user for the container is missing", None),
    (6, "iac", "checkov_encrypt_volume", "IaC: volume", "Volume is not encrypted at rest", None),
    (7, "cicd", "cicd_secret_api_key", "Plaintext secret in env: API_KEY", "Workflow sets a value", "cicd_plaintext_secret"),
    (7, "cicd", "cicd_missing_sast_gate", "No SAST gate in CI/CD", "No scanning step", "missing_sast_gate"),
    (8, "data_classification", "dc_sensitive_patient", "Sensitive category data: Patient", "Model holds diagnosis", "sensitive_category_data_detected"),
    (8, "data_classification", "dc_unencrypted_user", "Unencrypted PII fields: User", "Model holds email", "pii_field_unencrypted"),
    (8, "data_classification", "dc_custom", "Custom check", "A caller's own type", "type_outside_the_catalogue"),
]
SEVERITY_WORDS = ["critical", "high", "medium", "low", "info", "HIGH", "odd", None]

URLS = [
    "https://github.com/owner@/repo", "https://github.com/owner@/repo.git", "https://github.com/owner@/repo/",
    "git@github.com:owner@/repo.git", "git@github.com:owner@/repo", "https://gitlab.com/owner@/repo",
    "https://gitlab.com/group@/sub/project", "https://bitbucket.org/ws@/repo/src/main",
    "https://git.example.org/a/b@.git", "not-a-url-@", "ssh://git@gitlab.com/team@/tool.git",
    "http://github.com/only@", "zip://upload-@", "", "ftp://example.org/x@/y", "git@bitbucket.org:ws@/tool.git",
]

LICENSES = ["MIT", "GPL-3.0", "Apache-2.0", "LGPL-2.1-only", "AGPL-3.0-or-later", " gpl-2.0 ", "BSD-3-Clause"]
SUFFIXES = ["", "-linux-x64", "-darwin-arm64", "-linuxmusl-x64", "-win32-ia32", "-linux-riscv64", "-core"]

# run, uses, env key, env value (the key is NULL where the step has no env)
COMMANDS = [
    ("npm ci", None, None, None),
    ("docker push app:latest", None, "TOKEN", "${{ secrets.TOKEN }}"),
    (None, "sigstore/cosign-installer@v3", None, None),
    ("npm publish", None, "NPM_KEY", "abcdefghijklmnopqrstuvwx"),
    ("pytest -q", None, "MODE", "latest"),
    ("echo ghp_0123456789abcdef and AKIAABCDEFGH", None, "HOST", "example.org"),
    ("twine upload dist/*", None, "PYPI", "pypi-AgEIcHlwaS5vcmcCJDU2"),
    (None, "actions/checkout@v4", "LEVEL", "true"),
    ("semgrep ci", None, None, None),
    ("gpg --detach-sign out.tar", None, "STAGE", "sk-live_short"),
    ("cargo publish", "actions/cache@v4", "VAR", "${{vars.NAME_OF_A_VARIABLE}}"),
    ("make build", None, "EMPTY", ""),
]

FIELD_NAMES = [
    "id", "email", "user_phone", "first_name", "last_name", "created_at", "health_status", "ssn", "amount",
    "billing_address", "emailAddress", "passport_number", "notes", "union", "password", "dob", "status",
    "card_number", "title", "religion", "middle_name", "quantity", "national_id", "uid",
]
FIELD_TYPES = ["String", "Int", "Encrypted", "Text", "Date"]

FILE_PATHS = [
    "README.md", "SECURITY.md", ".github/CODEOWNERS", "infra/main.tf", "cloudformation/stack.yaml", "k8s/app.yml",
    "Dockerfile", "src/models.py", "prisma/schema.prisma", "api/openapi.yaml", "db/001.sql", "node_modules/x/a.tf",
    ".github/SECURITY.md", "CODEOWNERS", "src/user.entity.ts", "web/user.schema.js", "schema.graphql", "LICENSE",
    "app/Dockerfile.dev", ".github/workflows/ci.yml", "vendor/lib/models.py", "packages/core/schema.prisma",
    "infra/vars.tf.json",
]


def _indexed(rows):
    return [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]


def _values(rows, columns):
    return values_sql(_indexed(rows), "i, " + columns)


VIEWS = {
    "d_findings": f"""
        SELECT CAST(e.user_id * 10 + extract(day FROM e.ts) % 10 AS STRING) AS repo_id,
               c.src_ord, e.event_id AS pos, c.tool, s.severity, c.title, c.description,
               CASE e.event_id % 3
                 WHEN 0 THEN '/tmp/tmp' || CAST(e.user_id AS STRING) || '/src/' || e.event_type || '.py'
                 WHEN 1 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'x' || chr(92) || 'Temp' || chr(92) || 'tmp'
                        || CAST(e.user_id AS STRING) || chr(92) || e.event_type || chr(92) || 'a.ts'
                 ELSE '//src/' || e.event_type || '.go' END AS file_path,
               c.rule_id, c.finding_type,
               CASE WHEN e.event_id % 17 = 0 THEN 'See the team handbook.' END AS remediation
        FROM @events e
        JOIN (SELECT * FROM {_values(FINDINGS, "src_ord, tool, rule_id, title, description, finding_type")}) c
          ON e.event_id % {len(FINDINGS)} = c.i
        JOIN (SELECT * FROM {_values(SEVERITY_WORDS, "severity")}) s
          ON (e.event_id * 7 + e.user_id) % {len(SEVERITY_WORDS)} = s.i""",
    # One vulnerability per line item, of the package (part) in the repository (supplier)
    "d_vulns": """
        SELECT CAST(l_suppkey % 10 AS STRING) AS repo_id, 'pkg-' || CAST(l_partkey AS STRING) AS package,
               (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS pos, l_orderkey * 8 + l_linenumber AS report_no,
               'CVE-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id,
               CASE WHEN l_linestatus = 'F' THEN NULL
                    WHEN l_linenumber % 5 = 0 THEN 'Denial of service in parser'
                    WHEN l_linenumber % 5 = 1 THEN 'Session fixation after redirect'
                    WHEN l_linenumber % 5 = 2 THEN 'Open redirect in routing'
                    WHEN l_linenumber % 5 = 3 THEN 'Mail header flaw found with sendgrid'
                    ELSE 'Crash and password disclosure' END AS summary,
               CASE l_linenumber % 4
                 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) % 11 AS STRING) || '.5'
                 WHEN 1 THEN CASE WHEN l_returnflag = 'A' THEN 'CRITICAL' WHEN l_returnflag = 'N' THEN 'High' ELSE 'low' END
                 WHEN 2 THEN 'CVSS:3.1/AV:N/AC:L' END AS score
        FROM @lineitem""",
    "d_releases": """
        SELECT CAST(l_suppkey % 10 AS STRING) AS repo_id, 'pkg-' || CAST(l_partkey AS STRING) AS package, l_shipdate AS ts
        FROM @lineitem""",
    "d_components": f"""
        SELECT CAST(p.p_partkey % 40 AS STRING) AS repo_id, p.p_partkey AS pos,
               '@lib/' || replace(p.p_name, ' ', '-') || CAST(p.p_size % 5 AS STRING) || s.suffix AS name,
               '1.' || CAST(p.p_size AS STRING) AS version,
               CASE p.p_type WHEN 'ECONOMY' THEN 'pkg:npm/x' WHEN 'STANDARD' THEN 'pkg:pypi/x'
                    WHEN 'PROMO' THEN 'pkg:maven/x' WHEN 'SMALL' THEN 'pkg:gem/x' ELSE 'pkg:golang/x' END AS purl,
               CASE WHEN p.p_brand = 'Brand#7' THEN 'devDependency' ELSE 'library' END AS type,
               a.license AS license_id, b.license AS license_name
        FROM @part p
        JOIN (SELECT * FROM {_values(SUFFIXES, "suffix")}) s ON p.p_partkey % {len(SUFFIXES)} = s.i
        JOIN (SELECT * FROM {_values(LICENSES, "license")}) a ON (p.p_partkey * 3) % {len(LICENSES)} = a.i
        JOIN (SELECT * FROM {_values(LICENSES, "license")}) b ON (p.p_partkey * 5 + p.p_size) % {len(LICENSES)} = b.i""",
    "d_steps": f"""
        SELECT CAST(v.conv_id % 50 AS STRING) AS repo_id,
               '.github/workflows/w' || CAST(v.conv_id AS STRING) || '.yml' AS file_path,
               'flow ' || CAST(v.conv_id AS STRING) AS wf_name, v.role AS job, v.turn AS step_no,
               c.run, c.uses, c.env_key, c.env_value
        FROM @conversations v
        JOIN (SELECT * FROM {_values(COMMANDS, "run, uses, env_key, env_value")}) c
          ON (v.conv_id * 7 + v.turn * 3) % {len(COMMANDS)} = c.i""",
    "d_fields": f"""
        SELECT CAST(e.user_id % 10 AS STRING) AS repo_id, 'src/u' || CAST(e.user_id AS STRING) || '.prisma' AS source_file,
               'M' || CAST(e.user_id AS STRING) || '_' || e.event_type || '_' || CAST(extract(day FROM e.ts) AS STRING) AS model,
               0 AS model_pos, e.event_id AS field_pos, n.name, t.field_type,
               CAST(0 AS INT) AS line_number,
               CASE WHEN e.event_id % 29 = 0 THEN 'stored hashed' ELSE '' END AS comment
        FROM @events e
        JOIN (SELECT * FROM {_values(FIELD_NAMES, "name")}) n ON e.event_id % {len(FIELD_NAMES)} = n.i
        JOIN (SELECT * FROM {_values(FIELD_TYPES, "field_type")}) t
          ON CAST(floor(e.event_id / 24) AS BIGINT) % {len(FIELD_TYPES)} = t.i""",
    "d_files": f"""
        SELECT split_part(split_part(p.url, '//', 2), '/', 1) AS repo_id, f.path, p.page_id,
               CASE WHEN p.page_id % 4 = 0 THEN 'apiVersion: v1' || chr(10) || 'kind: Service' || chr(10) ELSE '' END
                 || p.html AS content
        FROM @pages p JOIN (SELECT * FROM {_values(FILE_PATHS, "path")}) f ON p.page_id % {len(FILE_PATHS)} = f.i""",
    "d_repos": f"""
        SELECT c.c_custkey, CAST(c.c_custkey AS STRING) AS repo_id,
               replace(u.url, '@', CASE WHEN u.url LIKE '%git@%' THEN '@' ELSE CAST(c.c_custkey % 50 AS STRING) END) AS url,
               CASE WHEN c.c_custkey % 3 = 0 THEN md5(c.c_name) WHEN c.c_custkey % 3 = 1 THEN '' END AS sha,
               c.c_custkey % 2 = 0 AS has_upload,
               c.c_custkey % 4 <> 0 AS private,
               CASE WHEN c.c_nationkey % 2 = 0 THEN 'main' ELSE 'trunk' END AS default_branch,
               CASE WHEN c.c_custkey % 5 = 0 THEN 'https://github.com/o/r/blob/master/SECURITY.md' END AS policy_url,
               CASE WHEN c.c_custkey % 3 = 0 THEN 200 ELSE 404 END AS legacy_status,
               c.c_custkey % 2 = 1 AS required_reviews,
               CASE WHEN c.c_nationkey % 3 = 0 THEN 200 ELSE 403 END AS rules_status,
               CAST(c.c_nationkey % 4 AS INT) AS n_rules,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN false WHEN c.c_mktsegment = 'MACHINERY' THEN true END AS org_2fa,
               CASE WHEN c.c_custkey % 7 < 3 THEN c.c_custkey % 7 = 0 END AS signatures_enabled
        FROM @customer c JOIN (SELECT * FROM {_values(URLS, "url")}) u ON c.c_custkey % {len(URLS)} = u.i""",
    "d_node_events": """
        SELECT CAST(e.user_id AS STRING) AS audit_id, n.node, e.ts, e.event_id,
               CASE e.event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'running' WHEN 2 THEN 'running'
                    WHEN 3 THEN 'skipped' ELSE 'completed' END AS status,
               CASE WHEN e.event_id % 7 = 0 THEN 'failed at ' || CAST(e.event_id AS STRING) END AS error
        FROM @events e
        JOIN (SELECT * FROM (VALUES (0, 'semgrep'), (1, 'osv'), (2, 'github'), (3, 'scan_secrets_pii'),
              (4, 'scan_repo_governance'), (5, 'scan_sbom_license'), (6, 'scan_iac_config'), (7, 'scan_cicd_security'),
              (8, 'scan_data_classification'), (9, 'orchestrator'), (10, 'fan_out')) AS t(i, node)) n
          ON (e.event_id * 3 + e.user_id) % 11 = n.i""",
    "d_cache": """
        SELECT CASE WHEN event_id % 3 = 0 THEN 'fb_' ELSE 'own_' END || CAST(user_id AS STRING) || '_' || event_type AS cache_key,
               props || CAST(event_id AS STRING) AS report, ts AS created_at, event_id
        FROM @events""",
}


def _order(name: str, seen: list[str]) -> list[str]:
    for other in re.findall(r"@(d_\w+)", VIEWS[name]):
        if other not in seen:
            _order(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def view(spark: SparkSession, sf_dir: str, name: str, **dealt_by: tuple[str, ...]) -> DataFrame:
    """A given table or a derived input as a DataFrame; ``dealt_by`` names given tables and the SQL they are dealt by.

    Dealt so, the given columns move, as numbers and codes, and the texts are made behind the shuffle.
    """
    if name in BASE:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return dealt(rows, *map(F.expr, dealt_by[name])) if name in dealt_by else rows
    used = sorted(set(re.findall(r"@(\w+)", re.sub(r"'[^']*'", "''", VIEWS[name]))))
    text = VIEWS[name]
    for other in used:
        view(spark, sf_dir, other, **dealt_by).createOrReplaceTempView(f"auditloom_{other}")
        text = re.sub(rf"(FROM|JOIN) @{other}\b", rf"\1 auditloom_{other}", text)
    # Spark would take "${...}" for a configuration variable
    return spark.sql(text.replace("${", "$' || '{"))


def dealt(rows: DataFrame, *keys) -> DataFrame:
    """Rows over as many partitions as the session shuffles to.

    The given tables are single row groups, which one task would read and work on alone; tables of many files need no
    such step.  The plan does not depend on the size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cte(*names: str) -> str:
    """The derived inputs as the ``WITH`` head of a DuckDB query (without the word WITH)."""
    seen: list[str] = []
    for name in names:
        _order(name, seen)
    parts = []
    for name in seen:
        text = re.sub(r"(FROM|JOIN) @(\w+)", r"\1 \2", VIEWS[name])
        parts.append(f"{name} AS ({text})")
    return ",\n".join(parts)
