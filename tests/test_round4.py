"""Round 4: cost of the streams' state, size of what the audit writes and moves."""

from __future__ import annotations

import random
import time

from pyspark.sql import Row

from auditloom.operators import packages
from auditloom.plans import audit
from auditloom.sources import store
from auditloom.streaming import barrier as sb


class CountedState:
    """A handle with values, maps and timers of one key; counts the calls, each of which is a message to the executor."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return CountedVariable(self, name)

    getMapState = lambda self, name, key, value: CountedVariable(self, name)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class CountedVariable:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _all(self):
        self.handle.calls += 1
        return self.handle.values

    def exists(self):
        return self.name in self._all()

    def get(self):
        return self._all().get(self.name)

    def update(self, value):
        self._all()[self.name] = value

    def clear(self):
        self._all().pop(self.name, None)

    def containsKey(self, key):
        return key in self._all().get(self.name, {})

    def getValue(self, key):
        return self._all()[self.name][key]

    def updateValue(self, key, value):
        self._all().setdefault(self.name, {})[key] = value

    def iterator(self):
        return iter(list(self._all().get(self.name, {}).items()))


def test_open_audit_is_read_and_written_once_a_batch():
    """the messages to the state do not grow with the events of a batch; the rows are those of a plain fold."""
    rng = random.Random(4)
    processor, handle = sb._closing(1_000_000), CountedState()
    processor.init(handle)
    events, at = [], 0
    for i in range(900):
        at += rng.choice([1, 10, 400_000, 1_000_000, 1_000_001])
        status = rng.choice(["running", "completed", "skipped", "error"])
        events.append(Row(audit_id="a", node=f"n{rng.randrange(7)}", event_id=i, status=status, error=f"bad {i}" if status == "error" else None, at_us=at))
    got, counts = [], []
    for start in range(0, 900, 300):
        batch = events[start:start + 300]
        rng.shuffle(batch)
        before = handle.calls
        got += processor.handleInputRows(("a",), iter(batch), None)
        counts.append(handle.calls - before)
        assert len(handle.timers) == 1
    got += processor.handleExpiredTimer(("a",), None, None)
    assert max(counts) <= 6 and not handle.values
    runs = [[events[0]]]
    for one, two in zip(events, events[1:]):
        if two.at_us > one.at_us + 1_000_000:
            runs.append([])
        runs[-1].append(two)
    want = []
    for run in runs:
        latest = {e.node: e.status for e in run}.values()
        status = "error" if "error" in latest else "running" if "running" in latest else "completed"
        # The error shown is the latest among the last errors of the nodes, which is the last of all.
        want.append((status, len(latest), max(((e.at_us, e.event_id, e.error) for e in run if e.error), default=(None,))[-1]))
    assert len(got) == len(runs) > 100
    assert [(r.opened_at, r.last_at) for r in got] == [(sb._at(run[0].at_us), sb._at(run[-1].at_us)) for run in runs]
    assert [(r.status, r.nodes, r.error) for r in got] == want


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_deals_rows_not_lists(spark):
    """tasks have cut the packages down, so the shuffle carries their rows; lists are made behind it."""
    rows = [("r", f"p{i % 3}", i if i % 7 else None, f"CVE-{i}" if i % 5 else None, f"text {i}", "high") for i in range(60)]
    rolled = packages.vuln_rollup(spark.createDataFrame(rows, "repo_id string, package string, pos bigint, id string, summary string, severity string"))
    lines = _plan(rolled).split("\n")
    moved = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert not any("collect_list" in line for line in lines[moved:])
    for row in rolled.collect():
        mine = sorted((r[2], r[3]) for r in rows if f"osv_{r[1]}" == row["rule_id"] and r[3] and r[2] is not None)
        lone = sum(f"osv_{r[1]}" == row["rule_id"] and r[3] is not None and r[2] is None for r in rows)
        # The count takes all vulnerabilities; rows without an id have a position, too.
        assert row["title"] == f"{row['rule_id'][4:]}: {len(mine) + lone} known vulnerabilities"
        assert row["pos"] == min(r[2] for r in rows if f"osv_{r[1]}" == row["rule_id"] and r[2] is not None)


def test_written_findings_leave_no_shuffle_files(spark, tmp_path):
    """what the findings were shuffled through goes with the write, and the session's settings are as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    names = ["spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    settings, before = [spark.conf.get(n) for n in names], shuffles()
    found = spark.range(200).selectExpr("id % 4 AS fw", "id").repartition(5, "id").groupBy("fw", "id").count()
    store.write_findings(found.selectExpr("concat('f', fw) AS framework", "id", "concat('text ', id) AS explanation"), f"{tmp_path}/found")
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert [spark.conf.get(n) for n in names] == settings
    assert spark.read.parquet(f"{tmp_path}/found").selectExpr("count(DISTINCT id)", "count(DISTINCT framework)").first() == (200, 4)


def test_scores_move_digests_of_texts(spark):
    """findings meet by digests of their texts, and texts that are cut elsewhere are other findings."""
    kind = "repo_id string, src_ord int, pos bigint, tool string, severity string, title string, description string, file_path string, rule_id string, finding_type string, remediation string"
    texts = [("ab", "c"), ("a", "bc"), ("ab", "c"), ("", "abc"), (None, "abc"), ("1:a", "b"), ("1", ":ab")]
    rows = [("r", 0, i, "semgrep", "high", title, text, None, None, None, None) for i, (title, text) in enumerate(texts)]
    reports = audit.audit_report(spark.createDataFrame(rows, kind))
    assert "sha2(" in _plan(reports)
    assert reports.first()["high"] == 5
