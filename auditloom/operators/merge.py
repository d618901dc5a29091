"""Merging and de-duplicating findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..dims import tools
from ..functions.severity import severity_rank
from ..functions.text import or_else
from ..schemas import FINDING, FINDING_COLUMNS

REQUIRED_COLUMNS = ("repo_id", "pos", "tool", "severity", "title", "description", "rule_id")
SOURCE_ORDER = {name: i for i, (name, _) in enumerate(tools.SOURCES)}


def as_findings(df: DataFrame, source: str | None = None) -> DataFrame:
    """Any finding-like table in the full layout; optional columns that are missing become NULL.

    Without its position, severity or rule id a finding can be neither ordered nor scored, so a table without these
    columns is refused.
    """
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if source is None and "src_ord" not in df.columns:
        missing.append("src_ord")
    if missing:
        raise ValueError(f"not a table of findings, it lacks {', '.join(missing)}")
    if source is not None:
        df = df.withColumn("src_ord", F.lit(SOURCE_ORDER[source]))
    columns = []
    for part in FINDING.split(","):
        name, kind = part.strip().split(" ")
        columns.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*columns)


def merge_findings(**sources: DataFrame) -> DataFrame:
    """Bag union of the finding sources, with the order of the sources kept in ``src_ord``."""
    merged = None
    for name in sorted(sources, key=SOURCE_ORDER.__getitem__):
        part = as_findings(sources[name], name)
        merged = part if merged is None else merged.unionByName(part)
    return merged


def dedup_by_rule(findings: DataFrame) -> DataFrame:
    """One finding per (repo, rule id): the most severe, ties to the earliest.

    Findings without a rule id stay alone.  The survivor takes the place of the
    first finding of its group.  A group aggregate, so copies are dropped before
    the shuffle.
    """
    # A finding without rule id and position is like no other.
    alone = findings.withColumn("_row", F.monotonically_increasing_id())
    own_key = F.concat_ws("_", F.lit("finding"), F.col("src_ord"), F.coalesce(F.col("pos").cast("string"), F.concat(F.lit("row"), "_row")))
    keyed = alone.withColumn("dedup_key", or_else(F.col("rule_id"), own_key)).drop("_row")
    place = F.struct("src_ord", "pos")
    # Greatest rank first, then the smallest place.
    best = F.struct(severity_rank(F.col("severity")), -F.col("src_ord"), -F.col("pos"))
    rest = [c for c in FINDING_COLUMNS if c not in ("repo_id", "src_ord", "pos")]
    groups = keyed.groupBy("repo_id", "dedup_key").agg(
        F.min(place).alias("place"), F.max_by(F.struct(*rest), best).alias("f")
    )
    return groups.select("repo_id", "place.src_ord", "place.pos", "f.*", "dedup_key")
