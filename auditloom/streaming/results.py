"""Results of audits that are held until some time after they were first read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Seconds a result is kept after it was first read
RESULT_SECONDS = 600

ANSWER = "result_id string, kind string, ts timestamp, event_id bigint, found boolean, reads bigint"


def _processor(keep_us: int):
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import Row

    class ResultProcessor(StatefulProcessor):
        """State of a result: when it was saved, when it was first read, how often since."""

        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("held", "saved_us bigint, first_us bigint, reads bigint")

        def handleInputRows(self, key, rows, timerValues):
            state = self.held.get() if self.held.exists() else None
            timed = state is not None and state[1] is not None
            first_timer = state[1] + keep_us if timed else None
            # One result is saved once and read a few times: its rows of a micro-batch are few.
            for row in sorted(rows, key=lambda r: (r["at_us"], r["event_id"])):
                at = row["at_us"]
                if state is not None and state[1] is not None and at >= state[1] + keep_us:
                    yield self.removal(key, state)
                    state = None
                if row["kind"] == "saved":
                    # A result that is held is only replaced; its life time goes on.
                    state = state or (at, None, 0)
                    continue
                found = state is not None
                if found:
                    state = (state[0], at if state[1] is None else state[1], state[2] + 1)
                yield Row(result_id=key[0], kind="read", ts=row["ts"], event_id=row["event_id"], found=found, reads=state[2] if found else 0)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state is None:
                self.held.clear()
            else:
                self.held.update(state)
                if state[1] is not None:
                    self.handle.registerTimer(-(-(state[1] + keep_us) // 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.held.exists():
                state = self.held.get()
                self.held.clear()
                yield self.removal(key, state)

        def removal(self, key, state):
            from datetime import datetime, timedelta, timezone

            at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=state[1] + keep_us)
            return Row(result_id=key[0], kind="removed", ts=at, event_id=None, found=True, reads=state[2])

        def close(self):
            pass

    return ResultProcessor()


def result_stream(events: DataFrame, keep_seconds: int = RESULT_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """Answers to reads of results, and the removal of each result ``keep_seconds`` after it was first read.

    ``events``: ``(result_id, kind, ts, event_id)``, kind ``saved`` or ``read``.  Output (append): a row per read
    (``found``: held then; ``reads`` so far) and a row ``removed`` per result that went.  A result that nobody reads
    stays; saving one that is held changes nothing, saving one that went begins anew.  Only held results have state,
    one row each; an event-time timer removes it.  Rows behind the watermark are dropped, as what they asked may be
    gone.  Needs the RocksDB state store (``state.rocksdb``).
    """
    keyed = events.withWatermark("ts", delay).select(
        F.col("result_id").cast("string").alias("result_id"), "kind", "ts", "event_id", F.unix_micros("ts").alias("at_us")
    )
    return keyed.groupBy("result_id").transformWithState(_processor(keep_seconds * 1_000_000), ANSWER, "append", "eventTime")
