"""Progress, rates and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import progress, rates
from auditloom.plans import audit
from auditloom.session import new_folder
from auditloom.streaming import barrier as sbarrier, progress as sprogress, rates as srates, results as sresults, state as sstate

from . import oracle as O
from .derived import view
from .registry import check

STATUS = f"""{O.inputs("d_node_events")},
    o AS (SELECT *, row_number() OVER (PARTITION BY audit_id, node ORDER BY ts DESC, event_id DESC) AS k,
            row_number() OVER (PARTITION BY audit_id, node, error IS NULL ORDER BY ts DESC, event_id DESC) AS ke FROM d_node_events),
    st AS (SELECT audit_id, node, max(CASE WHEN k = 1 THEN status END) AS status,
            strftime(min(CASE WHEN status = 'running' THEN ts END), '%Y-%m-%d %H:%M:%S') AS started_at,
            strftime(min(CASE WHEN status IN ('completed', 'skipped', 'error') THEN ts END), '%Y-%m-%d %H:%M:%S') AS completed_at,
            max(CASE WHEN ke = 1 THEN error END) AS error FROM o GROUP BY 1, 2)"""


def _shown(df):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.select("audit_id", "node", "status", F.date_format("started_at", fmt).alias("started_at"),
                     F.date_format("completed_at", fmt).alias("completed_at"), "error")


@check("node_status", O.with_(STATUS) + " SELECT * FROM st")
def node_status(spark, sf):
    return _shown(progress.node_status(view(spark, sf, "d_node_events")))


@check("audit_status", O.with_(STATUS) + """
    SELECT audit_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status <> 'running') THEN 'completed' ELSE 'running' END AS status,
           count(*) AS nodes FROM st GROUP BY 1""")
def audit_status(spark, sf):
    return progress.audit_status(progress.node_status(view(spark, sf, "d_node_events")))


@check("scan_completeness", O.with_(O.inputs("d_node_events")) + f"""
    SELECT audit_id, CAST(count(DISTINCT CASE WHEN status <> 'running' THEN node END) AS INTEGER) AS reported,
           count(DISTINCT CASE WHEN status <> 'running' THEN node END) = 9 AS complete
    FROM d_node_events WHERE node IN {O.in_list(progress.SCANNERS)} GROUP BY 1""")
def scan_completeness(spark, sf):
    return progress.scan_completeness(view(spark, sf, "d_node_events"))


def _requests(spark, sf):
    return view(spark, sf, "events").select(F.col("user_id").alias("client"), "ts", "event_id")


@check("burst_counts", """
    SELECT user_id AS client, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
           RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events""")
def burst_counts(spark, sf):
    return rates.burst_counts(_requests(spark, sf), 3600).select("client", "event_id", "n")


RATE_WINDOW = 48 * 3600


# The fold step by step: the n-th request of every client in the n-th step
DECISIONS = f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (
        SELECT user_id, event_id, rn, [us] AS taken, true AS allowed FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, event_id, rn, CASE WHEN len(held) < 10 THEN list_append(held, us) ELSE held END, len(held) < 10 FROM (
            SELECT e.user_id, e.event_id, e.rn, e.us, list_filter(f.taken, lambda t: t > e.us - {RATE_WINDOW * 1_000_000}) AS held
            FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
    SELECT user_id AS client, event_id, allowed FROM f"""


@check("rate_decisions", DECISIONS)
def rate_decisions(spark, sf):
    """A fold over each client's requests; also tested against a plain loop."""
    return rates.rate_decisions(_requests(spark, sf), 10, RATE_WINDOW)


@check("idle_clients", """
    SELECT user_id AS client, max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3600 SECOND AS idle FROM events GROUP BY 1""")
def idle_clients(spark, sf):
    return rates.idle_clients(_requests(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 3600).select("client", "idle")


# --------------------------------------------------------------------------- streams

def _event_stream(spark, sf):
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


# Third of the month of an event: the streams get one after the other.
PART = "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _in_runs(spark, sf, start):
    """``start(event stream, checkpoint)`` three times: a third of the month more each time, from the same checkpoint."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = new_folder(spark, "runs")
    for part in range(3):
        events.where(F.expr(PART) == part).write.parquet(f"{folder}/in/p{part}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        with sstate.rocksdb(spark):
            start(stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/checkpoint"


NODES = ["semgrep", "osv", "github", "scan_secrets_pii", "scan_repo_governance", "scan_sbom_license", "scan_iac_config",
         "scan_cicd_security", "scan_data_classification", "orchestrator", "fan_out"]


def _node(expr: str):
    return F.element_at(F.array(*map(F.lit, NODES)), F.expr(f"cast(({expr}) % 11 + 1 as int)"))


@check("progress_stream", O.with_(STATUS) + " SELECT * FROM st")
def progress_stream(spark, sf):
    state = F.col("event_id") % 7
    status = F.when(state == 0, "error").when(state.isin(1, 2), "running").when(state == 3, "skipped").otherwise("completed")
    events = _event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("audit_id"), _node("event_id * 3 + user_id").alias("node"), "ts", "event_id",
        status.alias("status"), F.when(state == 0, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
    )
    # The events of the file are one batch, in any order, so nothing may count as late.
    out = new_folder(spark, "progress")
    sprogress.write_updates(
        sprogress.progress_stream(events, "10 minutes"), f"{out}/table", f"{out}/checkpoint"
    ).awaitTermination()
    return _shown(sprogress.latest_updates(spark, f"{out}/table", ["audit_id", "node"]))


def _rate_runs(spark, sf, out):
    def start(events, checkpoint):
        requests = events.select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")
        return sprogress.write_updates(srates.rate_decision_stream(requests, 10, RATE_WINDOW), out, checkpoint, "append")

    return _in_runs(spark, sf, start)


@check("rate_decision_stream", DECISIONS)
def rate_decision_stream(spark, sf):
    """The decisions of ``rate_decisions`` on a stream that is started anew twice."""
    out = new_folder(spark, "rates")
    _rate_runs(spark, sf, out)
    return spark.read.parquet(out).select(F.col("client").cast("bigint").alias("client"), "event_id", "allowed")


@check("idle_client_state", DECISIONS.replace("SELECT user_id AS client, event_id, allowed FROM f", "") + f""",
    taken AS (SELECT user_id, us FROM f JOIN e USING (user_id, rn) WHERE allowed),
    ends AS (SELECT user_id, max(us) AS last FROM taken GROUP BY 1)
    SELECT user_id AS client, count(*) AS stored FROM taken JOIN ends USING (user_id)
    WHERE us > last - {RATE_WINDOW * 1_000_000} AND last + {RATE_WINDOW * 1_000_000} > (SELECT max(epoch_us(ts)) FROM events) GROUP BY 1""")
def idle_client_state(spark, sf):
    """What the store holds of the rate limits after three runs: nothing of clients that were idle for a window."""
    checkpoint = _rate_runs(spark, sf, new_folder(spark, "rates"))
    return sstate.state_counts(spark, checkpoint, "taken").select(F.col("key.client").cast("bigint").alias("client"), F.col("n").alias("stored"))


KEEP = 48 * 3600


@check("result_stream", f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_id % 4 = 0 AS saved, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (
        SELECT user_id, rn, us, saved, saved AS held, CAST(NULL AS BIGINT) AS first_us, 0 AS reads, false AS found, CAST(NULL AS BIGINT) AS gone, 0 AS gone_reads FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, us, saved, alive OR saved, CASE WHEN alive AND first_us IS NOT NULL THEN first_us WHEN alive AND NOT saved THEN us END,
               CASE WHEN alive AND NOT saved THEN reads + 1 WHEN alive THEN reads ELSE 0 END, alive AND NOT saved,
               CASE WHEN held AND NOT alive THEN first_us + {KEEP * 1_000_000} END, reads
        FROM (SELECT e.*, f.held, f.first_us, f.reads, f.held AND coalesce(e.us < f.first_us + {KEEP * 1_000_000}, true) AS alive
              FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)),
    ends AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
    SELECT user_id AS result_id, 'read' AS kind, us, found, CAST(CASE WHEN found THEN reads ELSE 0 END AS BIGINT) AS reads FROM f WHERE NOT saved
    UNION ALL SELECT user_id, 'removed', gone, true, gone_reads FROM f WHERE gone IS NOT NULL
    UNION ALL SELECT user_id, 'removed', first_us + {KEEP * 1_000_000}, true, reads FROM ends
    WHERE held AND first_us + {KEEP * 1_000_000} <= (SELECT max(epoch_us(ts)) FROM events)""")
def result_stream(spark, sf):
    """Reads of results and removals two days after the first read, over three runs."""
    out = new_folder(spark, "results")

    def start(events, checkpoint):
        kind = F.when(F.col("event_id") % 4 == 0, "saved").otherwise("read")
        steps = events.select(F.col("user_id").alias("result_id"), kind.alias("kind"), "ts", "event_id")
        return sprogress.write_updates(sresults.result_stream(steps, KEEP), out, checkpoint, "append")

    _in_runs(spark, sf, start)
    return spark.read.parquet(out).select(F.col("result_id").cast("bigint").alias("result_id"), "kind", F.unix_micros("ts").alias("us"), "found", "reads")


IDLE = 24 * 3600


@check("audit_status_stream", O.with_(O.inputs("d_node_events")) + f""",
    g AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY audit_id ORDER BY ts, event_id) AS gap FROM d_node_events),
    s AS (SELECT *, sum(CASE WHEN gap > {IDLE * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY audit_id ORDER BY us, event_id) AS no FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY audit_id, no, node ORDER BY us DESC, event_id DESC) AS rn FROM s)
    SELECT audit_id, min(us) AS opened, max(us) AS last,
           CASE WHEN bool_or(rn = 1 AND status = 'error') THEN 'error' WHEN bool_and(rn > 1 OR status <> 'running') THEN 'completed' ELSE 'running' END AS status,
           count(*) FILTER (rn = 1) AS nodes, arg_max(error, [us, event_id]) FILTER (error IS NOT NULL) AS error
    FROM k GROUP BY audit_id, no HAVING max(us) + {IDLE * 1_000_000} < (SELECT max(us) FROM s) - 600000000""")
def audit_status_stream(spark, sf):
    """Audits that nothing was heard of for a day, closed with the status of their nodes, over three runs."""
    out = new_folder(spark, "closed")

    def start(events, checkpoint):
        state = F.col("event_id") % 7
        status = F.when(state == 0, "error").when(state.isin(1, 2), "running").when(state == 3, "skipped").otherwise("completed")
        nodes = events.select(
            F.col("user_id").cast("string").alias("audit_id"), _node("event_id * 3 + user_id").alias("node"), "ts", "event_id",
            status.alias("status"), F.when(state == 0, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
        )
        return sprogress.write_updates(sbarrier.audit_status_stream(nodes, IDLE), out, checkpoint, "append")

    _in_runs(spark, sf, start)
    return spark.read.parquet(out).select(
        "audit_id", F.unix_micros("opened_at").alias("opened"), F.unix_micros("last_at").alias("last"), "status", "nodes", "error"
    )


@check("burst_count_stream", """
    WITH s AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS b FROM events),
    w AS (SELECT user_id, b - k.o * INTERVAL '6 hours' AS window_start FROM s, (VALUES (0), (1), (2), (3)) AS k(o))
    SELECT user_id AS client, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM w GROUP BY 1, 2""")
def burst_count_stream(spark, sf):
    """Sliding windows of a day, every six hours; the stream ends, so all windows are taken in update mode."""
    requests = _event_stream(spark, sf).select(F.col("user_id").alias("client"), "ts")
    out = new_folder(spark, "bursts")
    sprogress.write_updates(
        srates.burst_count_stream(requests, 86400, 21600), f"{out}/table", f"{out}/checkpoint"
    ).awaitTermination()
    latest = sprogress.latest_updates(spark, f"{out}/table", ["client", "window_start"])
    return latest.select("client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


# Audits of the stream are users; each event is a finding of one scanner.
STREAMED = [
    """sf0 AS (SELECT CAST(user_id AS STRING) AS repo_id, event_id % 9 AS node_no, 0 AS src_ord, event_id AS pos,
            'semgrep' AS tool, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
            'Rule ' || event_type AS title, 'Text' AS description, NULL AS file_path,
            CASE event_id % 5 WHEN 0 THEN 'a.sqli' WHEN 1 THEN 'b.hardcoded-password' WHEN 2 THEN 'c.xss' WHEN 3 THEN 'd.redos' ELSE 'e.plain' END AS rule_id,
            NULL AS finding_type, NULL AS remediation FROM events)""",
    "full_a AS (SELECT repo_id FROM sf0 GROUP BY 1 HAVING count(DISTINCT node_no) = 9)",
    "sf1 AS (SELECT * FROM sf0 WHERE repo_id IN (SELECT repo_id FROM full_a))",
    O.dedup("sf1", "u"), O.preset_cve("u", "t"), O.classify("t", "c"), O.mapped("c", "m"), O.scores("m", "full_a", "s"), O.report("s", "full_a"),
]


@check("incremental_findings", O.with_(*STREAMED) + """
    SELECT repo_id AS audit_id, overall_score, score_soc2, score_gdpr, critical, high, medium, low FROM s_report""")
def incremental_findings(spark, sf):
    """Reports of the stream after three runs: each audit's newest is the report of all its findings."""
    root = new_folder(spark, "incremental")
    _in_runs(spark, sf, lambda events, checkpoint: sprogress.incremental_findings(
        _streamed(events), root, checkpoint, audit.audit_report, wait_seconds=FOREVER, grace_seconds=FOREVER
    ))
    return sprogress.latest_reports(spark, root).select(
        "audit_id", "overall_score", "score_soc2", "score_gdpr", "critical", "high", "medium", "low"
    )


# Longer than the data: no audit times out, none is forgotten.
FOREVER = 90 * 86400


def _streamed(events):
    e = F.col("event_id")
    severity = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low"])), (e % 4 + 1).cast("int"))
    rule = F.element_at(F.array(*map(F.lit, ["a.sqli", "b.hardcoded-password", "c.xss", "d.redos", "e.plain"])), (e % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return events.select(
        "ts", F.col("user_id").cast("string").alias("audit_id"),
        F.element_at(F.array(*map(F.lit, NODES[:9])), (e % 9 + 1).cast("int")).alias("node"),
        F.lit(0).alias("src_ord"), e.alias("pos"), F.lit("semgrep").alias("tool"), severity.alias("severity"),
        F.concat(F.lit("Rule "), "event_type").alias("title"), F.lit("Text").alias("description"), none.alias("file_path"),
        rule.alias("rule_id"), none.alias("finding_type"), none.alias("remediation"),
    )


@check("released_audits", f"""
    WITH p AS (SELECT user_id, event_id % 9 AS node, {PART} AS part FROM events),
    first AS (SELECT user_id, node, min(part) AS part FROM p GROUP BY 1, 2),
    whole AS (SELECT user_id, max(part) AS part FROM first GROUP BY 1 HAVING count(*) = 9),
    n AS (SELECT user_id, part, sum(count(*)) OVER (PARTITION BY user_id ORDER BY part) AS n FROM p GROUP BY 1, 2),
    r AS (SELECT n.user_id, n.n, row_number() OVER (PARTITION BY n.user_id ORDER BY n.part) AS revision FROM n JOIN whole ON n.user_id = whole.user_id AND n.part >= whole.part)
    SELECT user_id AS audit_id, CAST(revision AS INTEGER) AS revision, CASE WHEN revision = 1 THEN 'complete' ELSE 'revised' END AS outcome,
           CAST(n AS BIGINT) AS n_findings, CAST(n AS BIGINT) AS given FROM r""")
def released_audits(spark, sf):
    """Each audit's first release, in the run in which its last scanner answers, and its revisions in later runs."""
    out = new_folder(spark, "released")
    _in_runs(spark, sf, lambda events, checkpoint: sprogress.write_updates(
        sbarrier.released_audits(_streamed(events), wait_seconds=FOREVER, grace_seconds=FOREVER), out, checkpoint, "append"
    ))
    return spark.read.parquet(out).groupBy(F.col("audit_id").cast("bigint").alias("audit_id"), "revision", "outcome", "n_findings").agg(
        F.count("tool").alias("given")
    )


@check("live_results", """
    SELECT CAST(event_id AS STRING) AS result_id FROM events
    WHERE event_id % 3 = 0 OR ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 600 SECOND""")
def live_results(spark, sf):
    results = view(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("result_id"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("first_read")
    )
    return sprogress.live_results(results, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("result_id")
