"""Audits on streams: closed when their nodes are done, reported when all scanners have answered."""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import DataFrame, functions as F

from ..operators.progress import DONE, SCANNERS
from ..schemas import FINDING, FINDING_COLUMNS

CLOSED = "audit_id string, opened_at timestamp, last_at timestamp, status string, nodes bigint, error string"
OPEN_AUDIT = (
    "first_us bigint, last_us bigint, "
    "nodes array<struct<node string, us bigint, event_id bigint, status string, error_us bigint, error_id bigint, error string>>"
)
RELEASED = f"audit_id string, revision int, outcome string, missing array<string>, n_findings bigint, {FINDING}"

#: Findings of an audit that go to its state at once.
STORED_ROWS = 1000

FINDING_TYPES = FINDING.split(", ")


def _at(us: int):
    from datetime import datetime, timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def _closing(idle_us: int):
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import Row

    closed_row = Row(*(part.split(" ")[0] for part in CLOSED.split(", ")))

    class ClosingProcessor(StatefulProcessor):
        """State of an open audit: its first and last event, and the latest status of each node.

        Each call to the state is a message to the executor, so an audit is read once a batch, worked on here and put
        back once.  While there is state, one timer stands, at the time that follows from the last event.
        """

        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("nodes", OPEN_AUDIT)

        def handleInputRows(self, key, rows, timerValues):
            state = self.state.get()
            first, last, nodes = (state[0], state[1], {v[0]: tuple(v)[1:] for v in state[2]}) if state is not None else (None, None, {})
            timer = None if last is None else self.due(last)
            rows = list(rows)
            names = rows[0].__fields__
            columns = itemgetter(*map(names.index, ("at_us", "event_id", "node", "status", "error")))
            # An audit has a known number of nodes with a few events each.
            for at, event_id, node, status, error in sorted(map(columns, rows), key=itemgetter(0, 1)):
                if last is not None and at > last + idle_us:
                    yield self.closed(key, first, last, nodes)
                    first, nodes = None, {}
                first, last = at if first is None else first, at
                old = nodes.get(node)
                told = (at, event_id, error) if error is not None else old[3:] if old else (None, None, None)
                nodes[node] = (at, event_id, status, *told)
            self.state.update((first, last, [(node, *v) for node, v in nodes.items()]))
            if timer != self.due(last):
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(self.due(last))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state = self.state.get()
            if state is not None:
                yield self.closed(key, state[0], state[1], {v[0]: tuple(v)[1:] for v in state[2]})
                self.state.clear()

        def due(self, last):
            return (last + idle_us) // 1000 + 1

        def closed(self, key, first, last, nodes):
            states = nodes.values()
            status = "running"
            if any(s[2] == "error" for s in states):
                status = "error"
            elif all(s[2] in DONE for s in states):
                status = "completed"
            errors = [s[3:] for s in states if s[5] is not None]
            return closed_row(key[0], _at(first), _at(last), status, len(states), max(errors)[2] if errors else None)

        def close(self):
            pass

    return ClosingProcessor()


def audit_status_stream(events: DataFrame, idle_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """One row per audit once nothing was heard of it for ``idle_seconds``: its status, by the latest of each node.

    ``events``: ``(audit_id, node, event_id, ts, status, error)``.  Two stateful operators under one watermark: events
    delivered twice go first, then a processor per audit keeps the latest status of each node and an event-time timer
    closes the audit.  ``status`` is ``error`` if a node ended in one, ``completed`` if all ended, else ``running``: an
    audit that was left.  ``error`` is the latest text.  Closing removes all state of the audit; a later event opens
    it anew.  Events behind the watermark are dropped.  Append mode.  Needs the RocksDB state store.
    """
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["audit_id", "node", "event_id"])
    keyed = unique.select("audit_id", "node", "event_id", "status", "error", "ts", F.unix_micros("ts").alias("at_us"))
    return keyed.groupBy("audit_id").transformWithState(_closing(idle_seconds * 1_000_000), CLOSED, "append", "eventTime")


def _barrier(scanners: tuple[str, ...], wait_ms: int, grace_ms: int):
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import Row

    bits = {s: 1 << i for i, s in reversed(list(enumerate(scanners)))}
    every = (1 << len(scanners)) - 1
    released_row = Row(*(part.split(" ")[0] for part in RELEASED.split(", ")))

    class BarrierProcessor(StatefulProcessor):
        """State of an audit: which scanners answered, its findings, and how often it was released."""

        def init(self, handle):
            self.handle = handle
            # revision: releases so far; until_ms: when the wait, or after a release the grace, is over.
            self.run = handle.getValueState("run", "arrived bigint, revision int, until_ms bigint, n bigint")
            self.held = handle.getListState("held", FINDING)

        def handleInputRows(self, key, rows, timerValues):
            arrived, revision, until, n = self.run.get() if self.run.exists() else (0, 0, None, 0)
            news, first_ms, timer, fresh, at = False, None, until, [], None
            for row in rows:
                if at is None:
                    at = {name: i for i, name in enumerate(row.__fields__)}
                    at_ms, node, tool, columns = at["at_ms"], at["node"], at["tool"], itemgetter(*(at[c] for c in FINDING_COLUMNS))
                first_ms = row[at_ms] if first_ms is None else min(first_ms, row[at_ms])
                bit = bits.get(row[node], 0)
                news |= bit & ~arrived != 0
                arrived |= bit
                if row[tool] is not None:
                    # Each call to the state is a message to the executor, so findings go there by many.
                    fresh.append(columns(row))
                    n, news = n + 1, True
                    if len(fresh) == STORED_ROWS:
                        self.held.appendList(fresh)
                        fresh = []
            if fresh:
                self.held.appendList(fresh)
            if until is None:
                until = first_ms + wait_ms
            whole = arrived == every
            # What comes after a release, findings or the answer of a scanner, makes a new revision.
            if whole and revision == 0 or revision and news:
                revision += 1
                until = max(until if revision > 1 else 0, self.clock(timerValues, first_ms) + grace_ms)
                yield from self.released(key, arrived, revision, n)
            self.run.update((arrived, revision, until, n))
            if until != timer:
                self.set_timer(until)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.run.exists():
                return
            arrived, revision, until, n = self.run.get()
            if revision == 0:
                # Some scanner did not answer in time: reported without it, and held for late findings.
                revision, until = 1, until + grace_ms
                yield from self.released(key, arrived, revision, n)
                self.run.update((arrived, revision, until, n))
                self.set_timer(until)
            else:
                self.run.clear()
                self.held.clear()

        def clock(self, timerValues, first_ms):
            return max(timerValues.getCurrentWatermarkInMs(), first_ms)

        def set_timer(self, until):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)

        def released(self, key, arrived, revision, n):
            missing = [s for i, s in enumerate(scanners) if not arrived >> i & 1]
            outcome = "revised" if revision > 1 else "timed out" if missing else "complete"
            head = (key[0], revision, outcome, missing, n)
            # A row without finding says that the audit was released: one without findings has a report, too.
            yield released_row(*head, *[None] * len(FINDING_COLUMNS))
            for finding in self.held.get():
                yield released_row(*head, *finding)

        def close(self):
            pass

    return BarrierProcessor()


def released_audits(
    stream: DataFrame, scanners=SCANNERS, wait_seconds: int = 3600, grace_seconds: int = 24 * 3600, delay: str = "10 minutes"
) -> DataFrame:
    """The findings of each audit, once all its scanners have answered.

    ``stream``: findings (``schemas.FINDING``) with ``audit_id``, ``node`` and ``ts``; a row with NULL ``tool`` only
    says that the scanner of ``node`` ended.  Output (append), per release: a row without finding and one per finding,
    all with ``revision`` (from 1), ``outcome``, the ``missing`` scanners and the number of findings.  ``complete``: all
    answered.  ``timed out``: some had not ``wait_seconds`` after the audit's first row.  ``revised``: findings or a
    scanner came after a release; all findings are given again.  ``grace_seconds`` after the last release the state of
    the audit is dropped; rows that come later begin a new run.  Rows behind the watermark are dropped.

    State holds open audits only, and the cost of a batch follows the audits it touches, not the history.  The
    findings of an audit are held on its task's disk (RocksDB) and handed on one by one, never gathered in memory.
    Needs the RocksDB state store (``state.rocksdb``).
    """
    scanners = tuple(scanners)
    if len(scanners) > 62:
        raise ValueError("at most 62 scanners")
    keyed = stream.withColumn("repo_id", F.col("audit_id")).withWatermark("ts", delay).select(
        "audit_id", "node", "ts", F.unix_millis("ts").alias("at_ms"), *[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in FINDING_TYPES]
    )
    return keyed.groupBy("audit_id").transformWithState(
        _barrier(scanners, wait_seconds * 1000, grace_seconds * 1000), RELEASED, "append", "eventTime"
    )
