"""Limit decisions on a request stream."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, functions as F

from ..operators.rates import LIMIT, WINDOW_SECONDS

DECISION = "client string, event_id bigint, ts timestamp, allowed boolean, late boolean"


def fits(taken: list[int], at: int, limit: int, window_us: int) -> bool:
    """Whether no window holds more than ``limit`` of the sorted accepted times once ``at`` is one of them."""
    near = taken[bisect_right(taken, at - window_us) : bisect_left(taken, at + window_us)]
    before = bisect_right(near, at)
    return before < limit and all(
        i + 1 - bisect_right(near, near[i] - window_us) < limit for i in range(max(before, limit - 1), len(near))
    )


def _processor(limit: int, window_seconds: int, delay_us: int):
    """Per-client processor: the last accepted times are the state, a timer drops idle clients."""
    from pyspark.sql.streaming import StatefulProcessor

    class RateProcessor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.taken = handle.getListState("taken", "at_us bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            window_us = window_seconds * 1_000_000
            watermark = timerValues.getCurrentWatermarkInMs()
            taken = sorted(row[0] for row in self.taken.get())
            batch = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
            answers = []
            for at in batch["at_us"].tolist():
                del taken[: bisect_right(taken, at - window_us - delay_us)]
                ok = fits(taken, at, limit, window_us)
                if ok:
                    insort(taken, at)
                answers.append(ok)
            if taken:
                del taken[: bisect_right(taken, taken[-1] - window_us - delay_us)]
            self.taken.put([(t,) for t in taken])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if taken:
                self.handle.registerTimer(max(taken[-1] // 1000, watermark) + window_seconds * 1000)
            yield pd.DataFrame({
                "client": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(),
                "ts": batch["ts"].to_numpy(), "allowed": answers,
                "late": (watermark > 0) & (batch["at_us"].to_numpy() <= watermark * 1000),
            })

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.taken.clear()
            return iter([])

        def close(self):
            pass

    return RateProcessor()


def rate_decision_stream(
    events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, delay: str = "0 seconds"
) -> DataFrame:
    """Accept or deny requests ``(client, ts, event_id)`` of a stream.

    Every request gets a decision.  One that comes after younger ones is accepted
    if no window then holds more than ``limit`` of the stored times; one behind the
    watermark is marked ``late``, as its decision rests on what is still stored.

    Accepted times are stored for a window and ``delay`` before the last one, at most
    ``limit`` a window; an event-time timer removes them one window after the last
    accepted request (or the watermark).  All requests of a client in a micro-batch
    are sorted in one task.  Needs the RocksDB state store.
    """
    epoch = "timestamp '1970-01-01 00:00:00'"
    delay_us = events.sparkSession.sql(f"SELECT unix_micros({epoch} + interval '{delay}') - unix_micros({epoch})").first()[0]
    # Spark drops late rows where it sees the watermarked column, so only a copy of the time goes on.
    keyed = (
        events.withColumn("at_us", F.unix_micros("ts"))
        .withWatermark("ts", delay)
        .select(F.col("client").cast("string").alias("client"), "event_id", F.timestamp_micros("at_us").alias("ts"), "at_us")
    )
    return keyed.groupBy("client").transformWithStateInPandas(
        _processor(limit, window_seconds, delay_us), DECISION, "append", "eventTime"
    )


def _gate(limit: int, window_seconds: int):
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import Row

    class GateProcessor(StatefulProcessor):
        """State of a client: one element per accepted request, each with a life time of a window."""

        def init(self, handle):
            self.taken = handle.getListState("taken", "event_id bigint", window_seconds * 1000)

        def handleInputRows(self, key, rows, timerValues):
            # What has expired is no longer given, whether it was removed yet or not.
            held = sum(1 for _ in self.taken.get())
            for row in rows:
                allowed = held < limit
                if allowed:
                    self.taken.appendValue((row["event_id"],))
                    held += 1
                yield Row(client=key[0], event_id=row["event_id"], allowed=allowed)

        def close(self):
            pass

    return GateProcessor()


def request_gate_stream(requests: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Accept or deny requests ``(client, event_id)`` by the time at which they are processed.

    As ``rate_decision_stream``, but on the clock of the engine: an accepted request is state for ``window_seconds``
    (``ttlDurationMs``), and a client with ``limit`` of these is denied.  The store removes what has expired, so idle
    clients cost nothing and no timer is kept.  Rows stream through; at most ``limit`` elements of a client are held.
    Needs the RocksDB state store.
    """
    keyed = requests.select(F.col("client").cast("string").alias("client"), "event_id")
    return keyed.groupBy("client").transformWithState(
        _gate(limit, window_seconds), "client string, event_id bigint, allowed boolean", "append", "processingTime"
    )


def burst_count_stream(
    events: DataFrame, window_seconds: int = WINDOW_SECONDS, slide_seconds: int = 10, delay: str = "1 minute"
) -> DataFrame:
    """Requests per client in sliding windows of a stream."""
    slots = F.window("ts", f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return (
        events.withWatermark("ts", delay)
        .groupBy("client", slots.alias("w"))
        .agg(F.count("*").alias("n"))
        .select("client", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )
