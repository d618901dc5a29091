"""Progress of audits from node events ``(audit_id, node, ts, event_id, status, error)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..dims import tools

SCANNERS = tuple(node for _, node in tools.SOURCES)
DONE = ("completed", "skipped", "error")


def node_status(events: DataFrame) -> DataFrame:
    """Latest status, start, completion and error of each (audit, node)."""
    order = F.struct("ts", "event_id")
    done = F.col("status").isin(*DONE)
    return events.groupBy("audit_id", "node").agg(
        F.max_by("status", order).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(done, F.col("ts"))).alias("completed_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"),
    )


def audit_status(nodes: DataFrame) -> DataFrame:
    """Overall status per audit from its nodes."""
    failed = F.bool_or(F.col("status") == "error")
    ended = F.bool_and(F.col("status").isin(*DONE))
    return nodes.groupBy("audit_id").agg(
        F.when(failed, "error").when(ended, "completed").otherwise("running").alias("status"),
        F.count("*").alias("nodes"),
    )


def scan_completeness(events: DataFrame, scanners=SCANNERS) -> DataFrame:
    """Audits with the number of scanners that ended, and whether all did."""
    reported = F.count_distinct(F.when(F.col("status").isin(*DONE), F.col("node")))
    return events.where(F.col("node").isin(*scanners)).groupBy("audit_id").agg(
        reported.cast("int").alias("reported"), (reported == len(scanners)).alias("complete")
    )
