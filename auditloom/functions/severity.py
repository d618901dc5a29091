"""Severity scales: mapping from scanner scales, ranks and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import once, strip

SEVERITIES = ("critical", "high", "medium", "low", "info")

# Rank and score weight of each severity, framework weights
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
SEVERITY_WEIGHT = {"critical": -20, "high": -10, "medium": -3, "low": -1, "info": 0}
FRAMEWORK_WEIGHT = {"soc2": 0.35, "iso27001": 0.25, "gdpr": 0.25, "dpdp": 0.15}
# Static-analysis levels
SAST_LEVELS = {"error": "critical", "warning": "high", "inventory": "low", "info": "low"}

NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"

#: A number without sign or blanks in front of a "/" or the end, and what any number, nan or infinity begins with.
PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?(?:/|\z)"
NUMBER_START = r"^\s*[+-]?[0-9.ni]"


def choose(col: Column, mapping: dict, default) -> Column:
    """Simple value mapping as one CASE."""
    case = None
    for key, value in mapping.items():
        branch = (col == F.lit(key), F.lit(value))
        case = F.when(*branch) if case is None else case.when(*branch)
    return case.otherwise(default)


def sast_severity(level: Column) -> Column:
    """Static-analysis level to severity; unknown levels are medium."""
    return choose(F.lower(level), SAST_LEVELS, F.lit("medium"))


def vuln_severity(score: Column) -> Column:
    """Advisory score text (label, number or vector) to severity.

    A label wins wherever it occurs; else the text before the first ``/`` is
    read as a number.  What is not a number (a vector, for one) is medium.
    Plain numbers and texts that cannot begin one, which are nearly all, are told apart first.
    """
    def by_number(n: Column) -> Column:
        return (
            F.when(n.isNull(), "medium").when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").otherwise("low")
        )

    def by_head(head: Column) -> Column:
        return (
            F.when(head.rlike(r"^(?:[+-]?nan|-inf(?:inity)?)$"), "low")
            .when(head.rlike(r"^\+?inf(?:inity)?$"), "critical")
            .otherwise(once(F.when(head.rlike(NUMBER), head.try_cast("double")), by_number))
        )

    def by_text(text: Column) -> Column:
        case = F
        for label in ("critical", "high", "medium", "low"):
            case = case.when(text.contains(label), label)
        head = F.substring_index(text, "/", 1)
        return (
            case.when(text.rlike(PLAIN_NUMBER), once(head.try_cast("double"), by_number))
            .when(~text.rlike(NUMBER_START), "medium")
            .otherwise(once(strip(head), by_head))
        )

    return F.when(score.isNull(), "medium").otherwise(once(F.lower(score), by_text))


def iac_severity(level: Column, check_name: Column) -> Column:
    """Infrastructure-check level to severity, raised for public buckets and open ranges."""
    name = F.coalesce(check_name, F.lit(""))
    sev = F.lower(F.coalesce(level, F.lit("")))
    exposed = (F.lower(name).contains("public") & F.lower(name).contains("bucket")) | name.contains("0.0.0.0")
    return (
        F.when(exposed, "high")
        .when(sev.isin("critical", "high"), "high")
        .when(sev.isin("medium", "moderate"), "medium")
        .when(sev == "low", "low")
        .otherwise("medium")
    )


def severity_rank(col: Column) -> Column:
    """Rank used by the dedup: a missing severity counts as low, unknown text as 0."""
    return choose(F.coalesce(col, F.lit("low")), SEVERITY_RANK, F.lit(0))


def rank_label(rank: Column) -> Column:
    return choose(rank, {r: s for s, r in SEVERITY_RANK.items()}, F.lit("info"))


def severity_weight(col: Column) -> Column:
    """Points a finding takes from a score; unknown severities take none."""
    return choose(F.lower(col), SEVERITY_WEIGHT, F.lit(0))
