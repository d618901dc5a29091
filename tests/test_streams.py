"""Streams equal their batch twins, over several micro-batches."""

import glob

import pytest
from pyspark.sql import functions as F

from auditloom.operators import mapping, merge, progress
from auditloom.plans import audit
from auditloom.streaming import barrier as sb, progress as sp, rates as sr, results as sres, state as st
from tests.test_jobs import plain_decisions, requests


@pytest.fixture
def file_stream(spark, tmp_path):
    """A DataFrame written as several files, read one file per micro-batch in name order."""

    def build(df, order, parts=4):
        folder = tmp_path / "in"
        rows = df.orderBy(order).collect()
        size = -(-len(rows) // parts)
        for i in range(parts):
            spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
        return (
            spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(folder))
        )

    return build


def test_rate_decision_stream(spark, file_stream, tmp_path):
    rows, df = requests(spark, 200, 9, 70)
    stream = file_stream(df, "ts", 3)
    out = str(tmp_path / "out")
    # Clients run on clocks of their own here, so the watermark must not drop the slower ones.
    with st.rocksdb(spark):
        sp.write_updates(sr.rate_decision_stream(stream, 10, 60, "1 day"), out, str(tmp_path / "cp"), "append").awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    assert got == plain_decisions(rows, 10, 60)


def test_late_requests_get_a_decision(spark, file_stream, tmp_path):
    sent = [("a", 1000), ("a", 1010), ("b", 1000), ("b", 1005), ("a", 1200), ("a", 1201), ("a", 1202), ("c", 1200),
            ("a", 1199), ("a", 1130), ("b", 900), ("c", 1300)]
    df = spark.createDataFrame([(c, i, t) for i, (c, t) in enumerate(sent)], "client string, event_id bigint, s bigint")
    df = df.select("client", "event_id", F.timestamp_seconds("s").alias("ts"))
    out = str(tmp_path / "out")
    stream = sr.rate_decision_stream(file_stream(df, "event_id", 3), 2, 60)
    with st.rocksdb(spark):
        sp.write_updates(stream, out, str(tmp_path / "cp"), "append").awaitTermination()
    got = {r["event_id"]: (r["allowed"], r["late"]) for r in spark.read.parquet(out).collect()}
    # Request 8 would be the third in the window that ends at 1201; 9 and 10 are late, but have room.
    assert got == {i: (i not in (6, 8), i in (8, 9, 10)) for i in range(len(sent))}


def test_progress_stream(spark, file_stream, tmp_path):
    rows = [("a", "osv", i, f"2024-01-01 00:0{i}:00", s, "bad" if s == "error" else None)
            for i, s in enumerate(["running", "error", "running", "completed"])]
    rows += [("b", "osv", 9, "2024-01-01 00:04:00", "running", None), ("b", "osv", 9, "2024-01-01 00:04:00", "running", None)]
    df = spark.createDataFrame(rows, "audit_id string, node string, event_id bigint, t string, status string, error string")
    df = df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    out = str(tmp_path / "out")
    sp.write_updates(sp.progress_stream(file_stream(df, "ts"), "1 hour"), out, str(tmp_path / "cp")).awaitTermination()
    got = sp.latest_updates(spark, out, ["audit_id", "node"]).select(*progress.node_status(df).columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, progress.node_status(df).collect()))
    assert {r["audit_id"]: r["status"] for r in progress.audit_status(got).collect()} == {"a": "completed", "b": "running"}


class Runs:
    """A stream that is started anew from its checkpoint for every part of its input."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def feed(self, rows, start):
        """``rows`` arrive; ``start(stream, checkpoint)`` starts the query, which ends when all is read."""
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/p{self.n}")
        schema = self.spark.read.parquet(f"{self.folder}/in/p1").schema
        stream = self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        stream = stream.withColumn("ts", F.timestamp_seconds("s")).drop("s")
        with st.rocksdb(self.spark):
            start(stream, f"{self.folder}/cp").awaitTermination()


def test_idle_clients_leave_no_state(spark, tmp_path):
    """Rate limits: state rows before and after the window, the stream started anew in between."""
    runs = Runs(spark, tmp_path, "client string, event_id bigint, s bigint")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream, checkpoint):
        return sp.write_updates(sr.rate_decision_stream(stream, 2, 60), out, checkpoint, "append")

    def held(variable="taken"):
        return {r["key"][0]: r["n"] for r in st.state_counts(spark, cp, variable).collect()}

    runs.feed([("a", 1, 1000), ("a", 2, 1010), ("a", 3, 1020), ("b", 4, 1015)], start)
    assert held() == {"a": 2, "b": 1}
    runs.feed([("b", 5, 1060)], start)
    assert held() == {"a": 2, "b": 2}
    assert {r["key"][0] for r in st.timer_rows(spark, cp).collect()} == {"a", "b"}
    runs.feed([("c", 6, 1500)], start)
    assert held() == {"c": 1}
    assert [r["key"][0] for r in st.timer_rows(spark, cp).collect()] == ["c"]
    assert {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_request_gate_forgets_by_the_clock(spark, tmp_path):
    """On the clock of the engine a stream never ends by itself, so each run is stopped once its answers are there."""
    import time

    runs = Runs(spark, tmp_path, "client string, event_id bigint, s bigint")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def feed(rows, total):
        def start(stream, checkpoint):
            query = sp.write_updates(sr.request_gate_stream(stream, 2, 20), out, checkpoint, "append", processingTime="200 milliseconds")
            end = time.time() + 60
            while time.time() < end and query.exception() is None:
                done = glob.glob(f"{out}/batch=*/_SUCCESS")
                if done and spark.read.parquet(out).count() >= total:
                    break
                time.sleep(0.2)
            query.stop()
            return query

        runs.feed(rows, start)
        return {r["key"][0]: r["n"] for r in st.state_counts(spark, cp, "taken").collect()}

    began = time.time()
    held = feed([("a", i, 0) for i in range(3)] + [("b", 9, 0)], 4)
    took = time.time() - began
    assert sorted(r["allowed"] for r in spark.read.parquet(out).where("client = 'a'").collect()) == [False, True, True]
    assert took > 20 or held == {"a": 2, "b": 1}
    time.sleep(21)
    held = feed([("a", 3, 0)], 5)
    assert spark.read.parquet(out).where("event_id = 3").first()["allowed"]
    # The batch has removed what had expired, the idle client's state, too.
    assert held == {"a": 1}


def test_results_go_after_their_first_read(spark, tmp_path):
    runs = Runs(spark, tmp_path, "result_id string, kind string, event_id bigint, s bigint")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream, checkpoint):
        return sp.write_updates(sres.result_stream(stream, 600), out, checkpoint, "append")

    runs.feed([("a", "read", 1, 90), ("a", "saved", 2, 100), ("b", "saved", 3, 100), ("a", "read", 4, 200)], start)
    runs.feed([("a", "saved", 5, 300), ("a", "read", 6, 799), ("c", "saved", 7, 700)], start)
    assert {r["key"][0] for r in st.state_rows(spark, cp, "held").collect()} == {"a", "b", "c"}
    runs.feed([("a", "read", 8, 800), ("c", "read", 9, 900), ("b", "read", 10, 2000)], start)
    got = sorted((r["ts"].timestamp(), r["result_id"], r["kind"], r["found"], r["reads"]) for r in spark.read.parquet(out).collect())
    assert got == [
        (90, "a", "read", False, 0), (200, "a", "read", True, 1), (799, "a", "read", True, 2), (800, "a", "read", False, 0),
        (800, "a", "removed", True, 2), (900, "c", "read", True, 1), (1500, "c", "removed", True, 1), (2000, "b", "read", True, 1)]
    assert {r["key"][0] for r in st.state_rows(spark, cp, "held").collect()} == {"b"}


def test_audits_close_when_idle(spark, tmp_path):
    runs = Runs(spark, tmp_path, "audit_id string, node string, event_id bigint, status string, error string, s bigint")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream, checkpoint):
        return sp.write_updates(sb.audit_status_stream(stream, 100, "0 seconds"), out, checkpoint, "append")

    runs.feed([("a", "x", 1, "running", None, 10), ("a", "y", 2, "error", "bad", 20), ("b", "x", 3, "running", None, 20),
               ("b", "x", 3, "running", None, 20)], start)
    runs.feed([("a", "y", 4, "completed", None, 30), ("a", "x", 5, "completed", None, 40), ("c", "x", 6, "running", None, 40)], start)
    runs.feed([("b", "x", 7, "error", "worse", 110), ("d", "x", 8, "completed", None, 300)], start)
    got = sorted((r["audit_id"], r["status"], r["nodes"], r["error"], r["last_at"].timestamp()) for r in spark.read.parquet(out).collect())
    assert got == [("a", "completed", 2, "bad", 40), ("b", "error", 1, "worse", 110), ("c", "running", 1, None, 40)]
    assert {r["key"][0] for r in st.state_rows(spark, cp, "nodes").collect()} == {"d"}


def finding_row(audit, node, pos, s, rule="a.sqli", tool="semgrep"):
    return (audit, node, s, None, 0, pos, tool, "high", rule, "Text", None, rule, None, None)


FINDING_STREAM = "audit_id string, node string, s bigint, repo_id string, src_ord int, pos bigint, tool string, severity string, title string, " \
                 "description string, file_path string, rule_id string, finding_type string, remediation string"


def test_release_late_findings_and_timeout(spark, tmp_path):
    """The barrier: nothing before all answered, a revision for what comes later, a timeout, and no state in the end."""
    runs = Runs(spark, tmp_path, FINDING_STREAM)
    root, cp = str(tmp_path / "tables"), str(tmp_path / "cp")

    def start(stream, checkpoint):
        return sp.incremental_findings(stream, root, checkpoint, audit.audit_report, ("x", "y"), 1000, 500, "0 seconds")

    def reports():
        return {r["audit_id"]: (r["revision"], r["outcome"], list(r["missing"]), r["high"]) for r in sp.latest_reports(spark, root).collect()}

    runs.feed([finding_row("a", "x", 1, 10), finding_row("b", "x", 1, 10), finding_row("n", "x", 0, 10, tool=None), finding_row("n", "y", 0, 11, tool=None)], start)
    assert reports() == {"n": (1, "complete", [], 0)}
    runs.feed([finding_row("a", "y", 2, 20, "b.xss")], start)
    assert reports()["a"] == (1, "complete", [], 2)
    runs.feed([finding_row("a", "y", 3, 30, "c.ssrf")], start)  # late, a restart after the release
    assert reports() == {"n": (1, "complete", [], 0), "a": (2, "revised", [], 3)}
    assert {r["key"][0]: r["n"] for r in st.state_counts(spark, cp, "held").collect()} == {"a": 3, "b": 1}
    runs.feed([finding_row("z", "x", 1, 1010)], start)  # b has waited long enough, the grace of a and n is over
    assert reports()["b"] == (1, "timed out", ["y"], 1)
    assert {r["key"][0] for r in st.state_rows(spark, cp, "run").collect()} == {"b", "z"}
    runs.feed([finding_row("b", "y", 2, 1100, "d.csrf"), finding_row("z", "y", 2, 1100)], start)
    assert reports()["b"] == (2, "revised", [], 2) and reports()["z"] == (1, "complete", [], 1)
    runs.feed([finding_row("q", "x", 1, 9000)], start)
    assert {r["key"][0]: r["n"] for r in st.state_counts(spark, cp, "held").collect()} == {"q": 1}


def test_incremental_findings(spark, tmp_path, findings):
    rows = []
    for audit_no in range(4):
        for i, node in enumerate(progress.SCANNERS):
            if audit_no == 3 and i == 8:
                continue  # the last audit never completes
            rows.append(finding_row(f"a{audit_no}", node, i, 100 + i, f"{node}.sqli", None if audit_no == 2 else "semgrep"))
    runs, root = Runs(spark, tmp_path, FINDING_STREAM), str(tmp_path / "tables")
    rows.sort(key=lambda r: r[2])
    for part in (rows[:12], rows[12:24], rows[24:]):
        runs.feed(part, lambda stream, checkpoint: sp.incremental_findings(stream, root, checkpoint, audit.audit_report))
    got = {r["audit_id"]: r for r in sp.latest_reports(spark, root).collect()}
    assert set(got) == {"a0", "a1", "a2"}
    df = spark.createDataFrame(rows, FINDING_STREAM).withColumn("repo_id", F.col("audit_id")).where("tool is not null")
    batch = {r["repo_id"]: r for r in audit.audit_report(df.drop("audit_id", "node", "s")).collect()}
    for name in ("a0", "a1"):
        assert got[name]["overall_score"] == batch[name]["overall_score"] and got[name]["high"] == 9
    assert got["a2"]["overall_score"] == 100  # complete, but no findings


def test_barrier(spark):
    rows = [("a", n, "completed") for n in progress.SCANNERS] + [("b", n, "completed") for n in progress.SCANNERS[:8]] + [("b", progress.SCANNERS[8], "running")]
    df = spark.createDataFrame(rows, "audit_id string, node string, status string")
    assert {r["audit_id"]: (r["reported"], r["complete"]) for r in progress.scan_completeness(df).collect()} == {"a": (9, True), "b": (8, False)}


def test_merge_order(findings):
    one = findings({"rule_id": "x", "severity": "low", "title": "from cicd"})
    two = findings({"rule_id": "x", "severity": "low", "title": "from semgrep"})
    merged = merge.merge_findings(cicd=one, semgrep=two)
    assert {r["title"]: r["src_ord"] for r in merged.collect()} == {"from semgrep": 0, "from cicd": 7}
    assert merge.dedup_by_rule(merged).first()["title"] == "from semgrep"
    assert mapping.classify(merged).count() == 2


def test_fresh_cache_stream(spark, file_stream, tmp_path):
    rows = [("own_1", "old", "2020-01-01 00:00:00"), ("own_2", "new", "2999-01-01 00:00:00"), ("fb_1", "old", "2020-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "cache_key string, report string, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    out = str(tmp_path / "out")
    sp.write_updates(sp.fresh_cache_stream(file_stream(df, "cache_key", 1)), out, str(tmp_path / "cp"), "append").awaitTermination()
    assert [r["cache_key"] for r in spark.read.parquet(out).collect()] == ["own_2"]
