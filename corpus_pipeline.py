"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return the
columns of ``documents``; the last returns the token ids of each document of the final mix.  Nulls, empty and very long
texts, repeated rows, empty tables and further columns are treated as the operators' docstrings say; further columns
are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.byte_bpe import encode_documents
from auditloom.llm.line_windows import drop_repeated_windows
from auditloom.llm.mixing import mix
from auditloom.llm.near_duplicates import keep_first_of_class
from auditloom.llm.quality import score_documents
from auditloom.llm.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good and not toxic; learned from ``labels`` and these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, labels).where("keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines and more are gone from all but their first place; ``n_chars`` follows the text.

    A document of which nothing is left goes; one that was blank from the start stays.
    """
    kept = drop_repeated_windows(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")) == "")
    kept = kept.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    return keep_first_of_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2, 1, repeating, and share 150% of all words."""
    return mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian bytes, with the digests of ids and of what they decode to."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: The classifier and the entropy balancing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
