"""Helpers shared by the corpus operators: written tables, free column names, hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again: later steps start from files.

    ``free``: what they were shuffled through is deleted with the write, not when the driver's memory is next cleaned.
    """
    folder, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, free or before)
    try:
        df.write.parquet(folder)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (whatever the case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a row by id and text: repeated rows share it, other texts of one id do not.

    The length in front of the id keeps (1, "2a") and (12, "a") apart; null and empty text are the same text.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(F.length(name), F.lit(":"), name, F.coalesce(F.col(text_col), F.lit("")))))


#: Keys with at least one in so many of all rows are hot; by counting there can be no more keys than this.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows with one facts row per key, where ``n`` counts the rows of the key.

    A key with 1/1000 or more of all counted rows would crowd one task.  There are at most 1000 such keys, so
    their facts are broadcast; the rest goes through a shuffle whose keys are all small.
    ``rows`` and ``facts`` should be written tables, since each is read twice.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE >= F.lit(total)
    hot, cold = facts.where(is_hot), facts.where(~is_hot)
    few = F.broadcast(hot)
    many = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(few, key).unionByName(many)
