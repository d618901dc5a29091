"""Removal of repeated runs of lines, found through overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import join_facts, row_key, unused, written

#: White space inside a line counts as one blank, white space around it not at all.
BLANKS = "[\\x20\\x09-\\x0D]+"


def _line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per window: digest, place (id, row key, first line) and last line.

    Lines without visible characters are passed over, so a window holds three lines with content.
    """
    clean = F.transform(
        F.split(F.col(text_col), "\n", -1),
        lambda line, i: F.struct(i.alias("no"), F.trim(F.regexp_replace(line, BLANKS, " ")).alias("line")),
    )
    lines = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"),
        F.filter(clean, lambda x: x["line"] != "").alias("lines"),
    ).where(F.size("lines") >= 3)
    triples = F.arrays_zip(
        F.col("lines").alias("a"), F.slice("lines", 2, F.size("lines")).alias("b"), F.slice("lines", 3, F.size("lines")).alias("c")
    )
    return lines.select("id", "row", F.explode(F.slice(triples, 1, F.size("lines") - 2)).alias("w")).select(
        F.unhex(F.md5(F.concat_ws("\n", "w.a.line", "w.b.line", "w.c.line"))).alias("digest"),
        F.struct("id", "row", F.col("w.a.no").alias("no")).alias("place"),
        F.array("w.a.no", "w.b.no", "w.c.no").alias("covered"),
    )


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every later occurrence of a three-line window taken out of the text.

    A window is three lines in a row that have visible characters; runs of white space in a line are equal to one
    blank.  Of all occurrences of a window in the whole table the earliest (smallest id, then smallest row digest,
    then first line) stays.  The lines of all others are removed; overlapping windows are merged, so a repeated
    passage of any length of three lines or more goes as one.  Judged on the input, not on what is left.

    Columns of ``docs`` stay, with the kept text, and three are added: ``n_lines`` (of the input), ``n_removed`` and
    ``removed`` (array of line numbers from 0, sorted; they refer to the input).  Null text: no lines, stays null.
    Empty text: one empty line.  Texts with fewer than three such lines have no window.  A null id is the smallest.
    Repeated rows (same id and text) share their place, so they are treated alike and stay as many.  An existing
    column named like an added one gets replaced.  Empty table: empty result.
    """
    windows = written(_line_windows(docs, id_col, text_col), "line-windows")
    firsts = written(
        windows.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-firsts"
    )
    later = join_facts(windows, firsts, "digest", "n").where(F.col("place") > F.col("first"))
    removed = later.groupBy(F.col("place.row").alias("row")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("removed")
    )
    key, gone = unused(docs, "row_key"), unused(docs, "gone_lines")
    removed = removed.select(F.col("row").alias(key), F.col("removed").alias(gone))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(removed.hint("merge"), key, "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    )
    return joined.withColumns({
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)),
        "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)),
        "removed": F.coalesce(F.col(gone), F.array().cast("array<int>")),
        text_col: kept,
    }).drop(key, gone)
