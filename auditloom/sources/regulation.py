"""Regulation texts: HTML to lines, lines to numbered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..operators.ordered import carry_forward

# Heading forms: pattern with the number as group 1, and the accepted numbers
ARTICLE = r"^Article\s+([0-9]+)$"
RULE = r"^([0-9]+)\.\s+"


def html_text(html: Column) -> Column:
    """Text of an HTML page with every tag as a line break; scripts, styles and comments dropped."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(text))
    return t


def regulation_lines(docs: DataFrame, is_html: bool = True) -> DataFrame:
    """Documents ``(doc_id, content)`` to stripped, non-empty lines in order."""
    text = html_text(F.col("content")) if is_html else F.col("content")
    return (
        docs.select("doc_id", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "raw"))
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), strip(F.col("raw")).alias("line"))
        .where("line <> ''")
    )


def segment(lines: DataFrame, heading: Column, block_rows: int = 100_000) -> DataFrame:
    """Cut ``(doc_id, line_no, line)`` at heading lines.

    A chunk runs from its heading to the line before the next one; lines before
    the first heading belong to none.  Gives (doc_id, start_line, heading, n_lines,
    content); the lines gathered per group are the text of one result row.
    """
    marked = lines.withColumn("start", F.when(heading, F.col("line_no")))
    owned = carry_forward(marked, ["doc_id"], "line_no", "start", "start_line", block_rows).where(
        "start_line is not null"
    )
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return owned.groupBy("doc_id", "start_line").agg(
        F.min_by("line", "line_no").alias("heading"),
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("content"),
    )


def _chunks(pieces: DataFrame, framework: str, prefix: str, key: str) -> DataFrame:
    number = F.col("number").cast("int")
    return pieces.select(
        "doc_id", "start_line",
        F.concat(F.lit(prefix), number.cast("string")).alias("id"),
        "content",
        F.lit(framework).alias("framework"),
        F.create_map(F.lit("framework"), F.lit(framework), F.lit(key), number.cast("string")).alias("metadata"),
    )


def segment_articles(lines: DataFrame) -> DataFrame:
    """GDPR chunks: lines ``Article n`` open a chunk, n from 1 to 99 is kept."""
    pieces = segment(lines, F.col("line").rlike(ARTICLE)).withColumn(
        "number", F.regexp_extract("heading", ARTICLE, 1).try_cast("bigint")
    )
    return _chunks(pieces.where("number between 1 and 99"), "gdpr", "gdpr_article_", "article")


def segment_rules(lines: DataFrame) -> DataFrame:
    """DPDP chunks: lines ``n. text`` open a chunk; only the first chunk of a number is kept."""
    pieces = segment(lines, F.col("line").rlike(RULE)).withColumn(
        "number", F.regexp_extract("heading", RULE, 1).try_cast("bigint")
    )
    first = pieces.groupBy("doc_id", "number").agg(
        F.min_by(F.struct("start_line", "content"), "start_line").alias("c")
    )
    return _chunks(first.select("doc_id", "number", "c.*"), "dpdp", "dpdp_rule_", "rule")
