"""Severity breakdown, framework scores, overall score and summary text.

All aggregates work on ``(repo, finding key)`` first, so a repository with very
many findings is reduced in parallel before one row per repository is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import as_df, controls
from ..functions.severity import FRAMEWORK_WEIGHT, SEVERITIES, severity_weight
from ..functions.text import or_else



def finding_key() -> list[Column]:
    """What makes two mapped rows the same finding for the scores."""
    return [
        F.coalesce("tool", F.lit("")).alias("k_tool"),
        or_else(F.col("rule_id"), F.coalesce("title", F.lit(""))).alias("k_rule"),
        F.coalesce("description", F.lit("")).alias("k_desc"),
    ]


def finding_digest() -> Column:
    """128 bits of SHA-256 in place of ``finding_key``: texts of any length are moved and compared as 16 bytes."""
    tool, rule, description = finding_key()
    told = F.concat(F.length(tool), F.lit(":"), tool, F.length(rule), F.lit(":"), rule, description)
    return F.substring(F.unhex(F.sha2(told, 256)), 1, 16)


def _first_severity() -> Column:
    """Severity of the first row of a group in finding order."""
    return F.min_by(F.lower("severity"), F.struct("src_ord", "pos")).alias("severity")


def severity_breakdown(mapped: DataFrame) -> DataFrame:
    """Findings per severity and repo, each finding counted once over all frameworks."""
    unique = mapped.groupBy("repo_id", *finding_key()).agg(_first_severity())
    return unique.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def framework_scores(mapped: DataFrame, repos: DataFrame) -> DataFrame:
    """Score 0..100 per (repo, framework); 100 where a repo has no rows."""
    unique = mapped.groupBy("repo_id", "framework", *finding_key()).agg(_first_severity())
    points = unique.groupBy("repo_id", "framework").agg(
        F.sum(severity_weight(F.col("severity"))).alias("points")
    )
    grid = repos.select("repo_id").withColumn("framework", F.explode(F.array(*map(F.lit, controls.FRAMEWORKS))))
    return grid.join(points, ["repo_id", "framework"], "left").select(
        "repo_id", "framework",
        F.greatest(F.lit(0), 100 + F.coalesce("points", F.lit(0))).cast("int").alias("score"),
    )


def weighted_score(scores: dict[str, Column]) -> Column:
    """Weighted mean of the four scores, rounded half to even, added in framework order."""
    total = F.lit(0.0)
    for fw in controls.FRAMEWORKS:
        total = total + F.lit(FRAMEWORK_WEIGHT[fw]).cast("double") * scores[fw].cast("double")
    return F.rint(total).cast("int")


def overall_score(scores: DataFrame) -> DataFrame:
    """One overall score per repo from (repo, framework, score) rows."""
    wide = scores.groupBy("repo_id").agg(
        *[F.max(F.when(F.col("framework") == fw, F.col("score"))).alias(fw) for fw in controls.FRAMEWORKS]
    )
    parts = {fw: F.coalesce(fw, F.lit(0)) for fw in controls.FRAMEWORKS}
    return wide.withColumn("overall_score", weighted_score(parts))


def framework_summary(mapped: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows and distinct controls per (repo, framework); zero where there are none."""
    found = mapped.groupBy("repo_id", "framework").agg(
        F.count("*").alias("findings"), F.count_distinct("control_id").alias("controls_triggered")
    )
    grid = repos.select("repo_id").withColumn("framework", F.explode(F.array(*map(F.lit, controls.FRAMEWORKS))))
    return grid.join(found, ["repo_id", "framework"], "left").na.fill(0, ["findings", "controls_triggered"])


def summary_text() -> Column:
    """Three fixed sentences from the numbers of a report row."""
    return F.format_string(
        "Overall compliance score is %d/100 (SOC2=%d, ISO27001=%d, GDPR=%d, DPDP=%d). "
        "%d unique findings: %d critical, %d high, %d medium, %d low, %d info. "
        "Controls triggered: SOC2=%d, ISO27001=%d, GDPR=%d, DPDP=%d.",
        "overall_score", *[f"score_{fw}" for fw in controls.FRAMEWORKS],
        "total_findings", *SEVERITIES,
        *[f"controls_{fw}" for fw in controls.FRAMEWORKS],
    )
