"""Node status, findings and result life time on streams.

Streams write to tables in the shared folder; each micro-batch owns its own
sub-folder, so a batch that is run again after a failure replaces its output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.progress import DONE, SCANNERS
from ..schemas import FINDING_COLUMNS
from ..sources.store import is_fresh
from .barrier import released_audits
from .results import RESULT_SECONDS
from .state import rocksdb


def progress_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Latest status per (audit, node) of a node-event stream, for update mode.

    An event delivered twice within the watermark is counted once.
    """
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["audit_id", "node", "event_id"])
    order = F.struct("ts", "event_id")
    return unique.groupBy("audit_id", "node").agg(
        F.max_by("status", order).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin(*DONE), F.col("ts"))).alias("completed_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"),
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", **trigger):
    """Starts a query that writes each micro-batch to ``path/batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys, schema: str | None = None) -> DataFrame:
    """Newest row per key over the batches of ``write_updates``."""
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def incremental_findings(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    report: Callable[[DataFrame, DataFrame], DataFrame],
    scanners=SCANNERS,
    wait_seconds: int = 3600,
    grace_seconds: int = 24 * 3600,
    delay: str = "10 minutes",
    **trigger,
):
    """Reports each audit as soon as all its scanners have answered, and again when more comes.

    ``stream`` and the rules of release: see ``barrier.released_audits``.  Every batch writes the reports of the audits
    it releases to ``root/reports/batch=<id>``, with ``revision``, ``outcome`` and ``missing``; ``latest_reports`` gives
    the newest per audit.  Nothing of earlier batches is read back.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        heads = rows.where("tool is null").select("audit_id", "revision", "outcome", "missing")
        # A batch that follows a long break may release an audit twice (timed out, then revised): the last counts.
        last = heads.groupBy("audit_id").agg(F.max_by(F.struct("revision", "outcome", "missing"), "revision").alias("head"))
        findings = rows.where("tool is not null").join(last, "audit_id").where("revision = head.revision").select(*FINDING_COLUMNS)
        # The repositories are given as well: an audit without findings has a report, too.
        full = report(findings, last.select(F.col("audit_id").alias("repo_id"))).withColumnRenamed("repo_id", "audit_id")
        full.join(last.select("audit_id", "head.*"), "audit_id").write.mode("overwrite").parquet(f"{root}/reports/batch={batch_id}")
        rows.unpersist()

    with rocksdb(stream.sparkSession):
        return (
            released_audits(stream, scanners, wait_seconds, grace_seconds, delay)
            .writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(step)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def latest_reports(spark: SparkSession, root: str) -> DataFrame:
    """The newest report of each audit."""
    return latest_updates(spark, f"{root}/reports", ["audit_id"])


def live_results(results: DataFrame, as_of) -> DataFrame:
    """Results still held: those read first no longer than ten minutes ago, or not yet read."""
    edge = as_of - F.make_interval(secs=F.lit(RESULT_SECONDS))
    return results.where(F.col("first_read").isNull() | (F.col("first_read") >= edge))


def fresh_cache_stream(cache: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Cache rows of a stream that are fresh when they arrive."""
    return cache.withWatermark("created_at", delay).where(
        is_fresh(F.col("cache_key"), F.col("created_at"), F.current_timestamp())
    )
