"""Request rates per client: plain trailing counts and limit decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import in_time_blocks, trailing_count, trailing_frame

# Requests per window and client, window length
LIMIT = 10
WINDOW_SECONDS = 60


def burst_counts(events: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Requests of the client in the window that ends at each request."""
    return trailing_count(events, "client", "ts", window_seconds * 1_000_000, "n")


# Windows per time block; a block starts at most one run
RUN_WINDOWS = 64
# Run of the requests before the first start of a client
BEFORE_FIRST = -(1 << 62)


def _runs(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Requests ``(client, run, _at, event_id, warm)`` in runs that can be decided on their own.

    A request with at most ``limit`` requests in its window, itself and its peers
    included, is accepted whatever came before.  Where all requests of the last
    window are of that kind, the accepted ones are known: they are all of them.  A
    run starts at the first such time of a time block and gets the requests of the
    window before it once more (``warm``) to start from.
    """
    frame = trailing_frame("client", window_us)
    # Two windows of reach: whether a request is sure needs one, whether all of the last window are needs two.
    spread = in_time_blocks(events.select("client", "ts", "event_id"), "ts", window_us * 8, 2 * window_us)
    marked = (
        spread.withColumn("_n", F.count("*").over(frame))
        .withColumn("_unsure", F.count_if(F.col("_n") > limit).over(frame))
        .where("_home = _block")
        .select("client", "event_id", F.col("_us").alias("_at"), "_unsure",
                F.floor(F.col("_us") / (window_us * RUN_WINDOWS)).alias("_block"))
    )

    # One row per time block: its start, the last start before it, the start of the next block.
    by_time = Window.partitionBy("client").orderBy("_block")
    blocks = (
        marked.groupBy("client", "_block")
        .agg(F.min(F.when(F.col("_unsure") == 0, F.col("_at"))).alias("start"))
        .withColumns({
            "before": F.last("start", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1)),
            "after": F.when(
                F.lead("_block").over(by_time) == F.col("_block") + 1, F.lead("start").over(by_time)
            ),
        })
    )
    own = F.when(F.col("_at") >= F.col("start"), F.col("start")).otherwise(F.col("before"))

    def warm(start) -> Column:
        near = (F.col("_at") < start) & (F.col("_at") > start - window_us)
        return F.when(near, F.struct(start.alias("run"), F.lit(True).alias("warm")))

    places = F.array_compact(F.array(
        F.struct(F.coalesce(own, F.lit(BEFORE_FIRST)).alias("run"), F.lit(False).alias("warm")),
        warm(F.col("start")), warm(F.col("after")),
    ))
    return marked.join(blocks, ["client", "_block"]).select("client", "_at", "event_id", F.inline(places))


def rate_decisions(events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Accept or deny each request ``(client, ts, event_id)`` in time order.

    A request is denied when ``limit`` accepted requests lie in its window; denied
    ones are not counted.  That is a fold, so it runs in Python, but over sorted
    Arrow batches with the last ``limit`` accepted times as the only state: no
    group is ever held in memory.  A client's requests are split into runs that do
    not depend on one another, see ``_runs``.
    """
    window_us = window_seconds * 1_000_000
    rows = _runs(events, limit, window_us)
    ordered = rows.repartition("client", "run").sortWithinPartitions("client", "run", "_at", "event_id")

    def decide(frames):
        from collections import deque

        key, taken = None, deque()
        for frame in frames:
            answers = []
            for client, run, at in zip(frame["client"], frame["run"], frame["_at"]):
                if (client, run) != key:
                    key, taken = (client, run), deque()
                while taken and taken[0] <= at - window_us:
                    taken.popleft()
                ok = len(taken) < limit
                if ok:
                    taken.append(at)
                answers.append(ok)
            yield frame[["client", "event_id"]].assign(allowed=answers)[~frame["warm"]]

    kind = dict(rows.dtypes)
    return ordered.mapInPandas(decide, f"client {kind['client']}, event_id {kind['event_id']}, allowed boolean")


def idle_clients(events: DataFrame, as_of, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Clients without a request in the window before ``as_of``: their state can be dropped."""
    edge = as_of - F.make_interval(secs=F.lit(window_seconds))
    last = events.groupBy("client").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("idle", F.col("last_seen") <= edge)
