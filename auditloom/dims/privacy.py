"""Curated privacy entries: keywords that select GDPR / DPDP wording for a finding.

Each entry: keywords searched in the lower-cased description and title, then the
GDPR and the DPDP explanation.  Entries without explanations mark findings that
carry no personal data.  First entry that matches wins.
"""

from __future__ import annotations

# Rule ids decided by the control catalogue alone
GOVERNANCE_RULE_IDS = ("github_branch_protection", "github_public_repo", "github_mfa")

# Controls every curated entry points at
CURATED_CONTROLS = {
    "gdpr": ("gdpr_article_32", "Security of Processing"),
    "dpdp": ("dpdp_rule_8", "Security Safeguards"),
}

# Keywords, GDPR explanation, DPDP explanation
CURATED = (
    (
        ("sql", "sqli", "injection", "database", "query"),
        "SQL injection can expose personal data stored in databases by bypassing application-level access controls. This violates GDPR Art. 32(1)(a) which requires appropriate technical measures to ensure ongoing confidentiality and integrity of processing systems.",
        "Unvalidated SQL queries risk unauthorized access to personal data, violating DPDP Rule 8(1) which requires reasonable security safeguards to prevent personal data breaches.",
    ),
    (
        ("secret", "hardcoded", "jwt", "credential", "password", "token", "key"),
        "Hardcoded credentials in source code bypass access controls and can expose personal data if a repository is compromised. This violates GDPR Art. 32(1)(b)'s requirement to ensure the ongoing confidentiality of processing systems.",
        "Embedded secrets in source code create a risk of unauthorized data access, violating DPDP Rule 8's requirement for technical safeguards to protect personal data throughout its lifecycle.",
    ),
    (
        ("path traversal", "ssrf", "file path", "directory", "file access"),
        "Path traversal vulnerabilities allow attackers to read arbitrary files, potentially exposing personal data stored on the server. This violates GDPR Art. 32(1)(d)'s requirement for processes to regularly test and evaluate the effectiveness of security measures.",
        "Unrestricted file access can lead to unauthorized disclosure of personal data, violating DPDP Rule 8's requirement for security safeguards that prevent unauthorized access to data.",
    ),
    (
        ("xss", "csrf", "cross-site", "cross site", "request forgery"),
        "Cross-site scripting allows attackers to execute code in users' browsers, potentially stealing session tokens and accessing personal data. This violates GDPR Art. 32(1)(a)'s obligation to implement measures protecting against unauthorized processing.",
        "XSS vulnerabilities can expose users' personal data to attackers, violating DPDP Rule 8's requirement for reasonable security safeguards, including protection against common web application attacks.",
    ),
    (
        ("crypto", "tls", "ssl", "md5", "sha1", "random", "encryption"),
        "Weak cryptographic algorithms (MD5, SHA1) or non-cryptographic random number generators undermine data protection measures. This violates GDPR Art. 32(1)(a) which requires pseudonymisation and encryption of personal data using state-of-the-art methods.",
        "Use of weak cryptography can lead to data exposure, violating DPDP Rule 8's requirement for appropriate technical safeguards including encryption standards for protecting personal data.",
    ),
    (
        ("deserialization", "code execution", "objectinputstream", "remote code"),
        "Unsafe deserialization can lead to remote code execution, giving attackers full access to processing systems. This violates GDPR Art. 32(1)(b)'s requirement for ensuring the ongoing confidentiality, integrity, and resilience of processing systems.",
        "Remote code execution vulnerabilities compromise the entire data processing environment, violating DPDP Rule 8's requirement to implement safeguards that prevent unauthorized access to personal data.",
    ),
    (
        ("cookie", "session", "httponly", "secure flag", "authentication"),
        "Insecure cookie flags (missing HttpOnly or Secure) allow session hijacking via XSS or network eavesdropping. This violates GDPR Art. 32(1)(a) which requires encryption and confidentiality measures for personal data in transit.",
        "Insecure session management can expose user sessions to hijacking, violating DPDP Rule 8's requirement to implement security safeguards that protect personal data during processing and transmission.",
    ),
    (
        ("redirect", "open redirect", "url injection"),
        "Open redirect vulnerabilities can be used in phishing attacks to trick users into revealing credentials or personal data. This violates GDPR Art. 32(1)(c)'s requirement for ensuring the ongoing resilience of processing systems.",
        "Open redirects create phishing risks that can lead to personal data exposure, violating DPDP Rule 8's requirement for safeguards against social engineering and deception-based attacks.",
    ),
    (
        ("cve", "known vulnerability", "dependency", "xstream", "cpe"),
        "Known vulnerabilities in third-party dependencies are unpatched security gaps that attackers can exploit to access personal data. This violates GDPR Art. 32(1)(d)'s requirement for regular testing and evaluation of security measures.",
        "Unpatched dependency vulnerabilities create exploitable attack vectors for data breaches, violating DPDP Rule 8's requirement for ongoing security safeguards including vulnerability management.",
    ),
    (("mfa", "2fa", "branch protection", "public repository"), None, None),
    (("docker", "container", "root"), None, None),
)


def curated_rows() -> list[tuple[int, str, str, str, str]]:
    """(entry, framework, control_id, control_name, explanation) of the personal-data entries."""
    rows = []
    for entry, (_, gdpr, dpdp) in enumerate(CURATED):
        for framework, text in (("gdpr", gdpr), ("dpdp", dpdp)):
            if text:
                rows.append((entry, framework, *CURATED_CONTROLS[framework], text))
    return rows
