"""Keyed state of the streams: the store it needs, and what a checkpoint holds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the streams that start inside; then the one set before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def state_rows(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """Rows of a state variable as of the last batch of a stream: ``key``, and ``value`` or ``list_element``.

    List and map variables give a row per element.  The stream need not run; nothing is changed.
    """
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(checkpoint)


def timer_rows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Registered timers of a stream: ``key`` and ``expiration_timestamp_ms``."""
    return spark.read.format("statestore").option("operatorId", operator).option("readRegisteredTimers", True).load(checkpoint)


def state_counts(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """Stored rows per key of a state variable; a key that was evicted has none."""
    return state_rows(spark, checkpoint, variable, operator).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
