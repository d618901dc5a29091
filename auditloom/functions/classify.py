"""Finding-type classification as column expressions (no join, no shuffle)."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, functions as F

from ..dims import controls, privacy, rules, sql_literal, tools
from .text import has_any, has_words, once


def _any(name: str, words) -> str:
    return "(" + " OR ".join(f"contains(x.{name}, {sql_literal(w)})" for w in words) + ")"


def _rule_test(kind: str, needle: str, words) -> str:
    text = sql_literal(needle)
    if kind == "exact":
        return f"x.rid = {text}"
    if kind == "contains":
        return f"contains(x.rid, {text})"
    return f"startswith(x.rid, {text})" + (f" AND {_any('dsc', words)}" if words else "")


def _once(body: str, **inputs: str) -> Column:
    """``body`` over named inputs ``x.<name>``, each computed once per row.

    A CASE with many branches over an expression would repeat that expression in
    every branch, and inside whole-stage code it makes a method too long for the
    JIT compiler.  A one-element ``transform`` avoids both.
    """
    fields = ", ".join(f"'{name}', {text}" for name, text in inputs.items())
    return F.expr(f"get(transform(array(named_struct({fields})), x -> {body}), 0)")


def _lowered(column: str) -> str:
    return f"lower(coalesce({column}, ''))"


def rule_text(column: str) -> str:
    """SQL of a rule id in the form the rules are compared with."""
    return f"regexp_replace({_lowered(column)}, r'^\\s+|\\s+$', '')"


def finding_type(
    rule_id: str = "rule_id", description: str = "description", preset: str = "finding_type"
) -> Column:
    """Type of a finding: the preset one, else the first rule that matches, else the default.

    Neighbouring rules with the same outcome become one branch of the CASE.
    """
    branches = [
        f"WHEN {' OR '.join('(' + _rule_test(*row[2:]) + ')' for row in group)} THEN {sql_literal(outcome)}"
        for outcome, group in groupby(rules.rule_rows(), key=lambda row: row[1])
    ]
    body = f"CASE WHEN x.preset <> '' THEN x.preset {' '.join(branches)} ELSE {sql_literal(controls.DEFAULT_TYPE)} END"
    unset = f"if({preset} <> '', '', {{}})"
    return _once(body, rid=unset.format(rule_text(rule_id)), dsc=unset.format(_lowered(description)), preset=preset)


def known_type(col: Column) -> Column:
    """The type itself if the catalogue has it, else the default type.

    Never null, and told so: a join on a value that may be null is preceded by a filter, which would classify each finding once more.
    """
    return F.coalesce(F.when(col.isin(controls.finding_types()), col), F.lit(controls.DEFAULT_TYPE))


def cve_subtype(description: Column) -> Column:
    """Impact class of a dependency advisory from its whole description.

    Words of data and network go before those of denial of service, which is also the class of all other texts.
    """
    def by_text(text: Column) -> Column:
        hit = lambda words: has_words(text, words, rules.CVE_WHOLE_WORDS)
        return (
            F.when(hit(rules.CVE_EMAIL_WORDS), "dependency_cve_email")
            .when(hit(rules.CVE_DATA_WORDS), "dependency_cve_data")
            .when(hit(rules.CVE_NETWORK_WORDS), "dependency_cve_network")
            .otherwise("dependency_cve_dos")
        )

    return once(F.lower(F.coalesce(description, F.lit(""))), by_text)


def curated_entry(
    rule_id: str = "rule_id", title: str = "title", description: str = "description", preset: str = "finding_type"
) -> Column:
    """Number of the first curated privacy entry for a finding.

    -1: decided by the catalogue alone (governance ids); NULL: no entry, or a
    preset type, so the catalogue fallback applies.  Title and description are
    searched as one text; no keyword has a line break in it.
    """
    ids = ", ".join(sql_literal(i) for i in privacy.GOVERNANCE_RULE_IDS)
    branches = [
        f"WHEN {_any('txt', words)} THEN {entry}"
        for entry, (words, _, _) in enumerate(privacy.CURATED)
    ]
    body = f"CASE WHEN x.rid IN ({ids}) THEN -1 WHEN x.preset <> '' THEN NULL {' '.join(branches)} END"
    text = f"if({preset} <> '', '', lower(concat_ws(chr(10), {description}, {title})))"
    return _once(body, rid=f"coalesce({rule_id}, '')", txt=text, preset=preset)


def iac_type(check_id: Column, check_name: Column) -> Column:
    """Finding type of an infrastructure check from its id and name."""
    cid, name = F.lower(F.coalesce(check_id, F.lit(""))), F.lower(F.coalesce(check_name, F.lit("")))
    docker = cid.contains("docker")
    return (
        F.when(docker & (name.contains("healthcheck") | cid.endswith("_2")), "iac_docker_healthcheck")
        .when(docker & (has_any(name, ("user", "root")) | cid.endswith("_3")), "iac_docker_user")
        .when(
            (cid.contains("s3") & has_any(name, ("public", "acl", "policy", "versioning", "encryption")))
            | (cid.contains("google_storage_bucket") & name.contains("public")),
            "iac_storage_misconfigured",
        )
        .when(cid.contains("s3") & name.contains("log"), "iac_logging_missing")
        .when(
            (has_any(cid, ("sg", "security_group", "network", "cidr"))
             & has_any(name, ("0.0.0.0", "any", "open", "public")))
            | (cid.contains("eks") & name.contains("public"))
            | (cid.contains("google_compute_firewall") & name.contains("open")),
            "iac_network_exposed",
        )
        .when(has_any(cid, ("encrypt", "kms", "key", "ssl", "tls")), "iac_encryption_missing")
        .when(has_any(cid, ("log", "cloudtrail", "monitor", "audit")), "iac_logging_missing")
        .otherwise("iac_storage_misconfigured")
    )


def iac_framework(path: Column, content: Column, head_chars: int | None = None) -> Column:
    """Infrastructure framework of a file (path relative to the repo), or NULL.

    A YAML file is searched for Kubernetes keys as a whole, or only in its first ``head_chars``.
    """
    name = F.element_at(F.split(path, "/"), -1)
    # A file in the root is seen as "./name", so the folder test still needs a slash.
    yaml = F.lower(name).rlike(r"\.ya?ml$")
    head = content if head_chars is None else F.substring(content, 1, head_chars)
    kinds = "|".join(tools.KUBERNETES_KINDS)
    return (
        F.when(name.rlike(r"(?i)\.tf(?:\.json)?$"), "Terraform")
        .when(yaml & path.rlike(r"(?:cloudformation|template)/|AWSTemplateFormatVersion"), "CloudFormation")
        .when(yaml & head.rlike(rf"(?m)^apiVersion:|^kind:\s*(?:{kinds})\s*$"), "Kubernetes")
        .when((F.upper(name) == "DOCKERFILE") | name.startswith("Dockerfile"), "Dockerfile")
    )


def ecosystem(purl: Column) -> Column:
    """Package ecosystem from a package URL, empty when unknown."""
    purl = F.coalesce(purl, F.lit(""))
    case = F.when(F.lit(False), "")
    for needle, name in tools.ECOSYSTEMS:
        case = case.when(purl.contains(needle), name)
    return case.otherwise("")


def base_package(name: Column) -> Column:
    """Package name without a ``-<os>-<arch>`` suffix."""
    return F.regexp_replace(name, tools.PLATFORM_SUFFIX_PATTERN, "")


def copyleft_license(licenses: Column) -> Column:
    """First copyleft id of a license array (ids already lower-cased), or NULL."""
    return F.get(F.filter(licenses, lambda x: x.isin(*tools.COPYLEFT_LICENSES)), 0)
