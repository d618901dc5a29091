"""Ordered computations that stay balanced when one key holds much of the data.

A plain window sends all rows of a key to one task.  Here a key is cut into
blocks of its order column, each block is worked on by itself, and only one
small row per block is looked at per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def carry_forward(
    df: DataFrame, keys, order: str, value: str, name: str, block_rows: int = 100_000
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, per key, in ``order`` (a whole number).

    The input is read twice, the second time only its key, order and value columns; give a stored table where it is costly to make.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn("_local", F.last(value, ignorenulls=True).over(inside))

    # One row per block: its last value; then the last value of the blocks before it.
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return (
        local.join(carried, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop("_block", "_local", "_carried")
    )


def in_time_blocks(df: DataFrame, ts: str, span_us: int, reach_us: int) -> DataFrame:
    """Rows by time block, with the rows of the last ``reach`` of a block in the next one, too.

    Adds ``_us`` (time), ``_block`` (the row's own block) and ``_home`` (the block
    a copy works in), so that windows of up to ``reach`` are whole inside a home.
    """
    own = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_block", F.floor(F.col("_us") / span_us)
    )
    reaches_next = F.col("_us") > (F.col("_block") + 1) * span_us - reach_us
    copies = F.when(reaches_next, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    return own.withColumn("_home", F.explode(copies))


def trailing_frame(key: str, window_us: int):
    """Window over ``in_time_blocks`` rows: the same key in ``(t - window, t]``, peers included."""
    return Window.partitionBy(key, "_home").orderBy("_us").rangeBetween(-(window_us - 1), 0)


def trailing_count(
    df: DataFrame, key: str, ts: str, window_us: int, name: str, blocks_per_window: int = 8
) -> DataFrame:
    """Rows of the same key in ``(t - window, t]``, the row itself and its peers included."""
    spread = in_time_blocks(df, ts, window_us * blocks_per_window, window_us)
    return (
        spread.withColumn(name, F.count("*").over(trailing_frame(key, window_us)))
        .where("_home = _block")
        .drop("_us", "_block", "_home")
    )


def top_per_key(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First ``k`` rows per key.  The rank filter is applied map-side too, so at most
    ``k`` rows per key and task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _running(df: DataFrame, block, order: list) -> DataFrame:
    """``pos``: number of the row in its repository, from 0, blocks in their order and rows in theirs.

    A block is ranked by itself; in front of it count the rows of the blocks before, of which each is one small row.
    """
    keyed = df.withColumn("_block", F.struct("repo_id", *block))
    sizes = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_block.repo_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order)).cast("bigint") - 1
    placed = keyed.withColumn("_place", inside).join(starts, "_block")
    return placed.withColumn("pos", F.col("_before") + F.col("_place")).drop("_block", "_before", "_place")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``: their number within the repository, by the given columns.

    For findings that have no number of their own.  The first column, such as the file, cuts a repository into blocks,
    so a repository may hold any share of the rows; the input is read twice.
    """
    block = [F.col(order[0]).alias("b")] if order else [F.lit(0).alias("b")]
    return _running(df, block, list(order) or ["repo_id"])


#: Positions of a source that make a block.
BLOCK_POSITIONS = 100_000


def in_turn(*parts: DataFrame) -> DataFrame:
    """The findings of several checks of one source, check after check; ``pos`` runs through."""
    merged = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    block = [F.col("_part").alias("p"), F.floor(F.col("pos") / BLOCK_POSITIONS).alias("b")]
    return _running(merged, block, ["pos"]).drop("_part")
