"""Findings to framework controls.

All rule tables are constants of fewer than 200 rows, so the joins below are
broadcast joins by construction and no finding is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import as_df, controls, privacy
from ..functions.classify import (
    curated_entry, cve_subtype, finding_type, known_type, rule_text,
)
from ..functions.text import filled, or_else
from .keyed import GRAM, join_by_hot_keys, pieces


SECURITY_TEXT = "Finding '%s' falls under %s (%s)."
PRIVACY_TEXT = "Finding '%s' relates to %s (%s) as it involves processing of personal data."


def classify(findings: DataFrame) -> DataFrame:
    """Adds ``resolved_type``: preset type, rule, or default."""
    return findings.withColumn("resolved_type", finding_type())


def _rules_of(rids: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_rid, prio, finding_type, desc_needles)`` of all rules that a rule id meets, found by index.

    Exact rules meet by the whole id, prefixes by the id's beginnings of the lengths that occur, and contained needles
    by their first piece of up to GRAM letters.
    """
    told = ("prio", "finding_type", "desc_needles")
    exact = rids.join(rules.where("kind = 'exact'").select(F.col("needle").alias("_rid"), *told), "_rid")
    prefixes = rules.where("kind = 'prefix'")
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length("needle")))).scalar()
    begins = F.array_distinct(F.transform(F.col("_lengths"), lambda n: F.left(F.col("_rid"), n)))
    begun = rids.withColumn("_lengths", lengths).select("_rid", F.explode(begins).alias("needle")).join(prefixes.select("needle", *told), "needle")
    inner = rules.where("kind = 'contains'").withColumn("_piece", F.left("needle", F.lit(GRAM)))
    held = rids.select("_rid", F.explode(F.concat(F.array(F.lit("")), pieces("_rid"))).alias("_piece")).join(inner, "_piece")
    held = held.where(F.col("_rid").contains(F.col("needle")))
    found = exact.select("_rid", *told).unionByName(begun.select("_rid", *told))
    # Only a prefix may ask for words of the description.
    return found.unionByName(held.select("_rid", "prio", "finding_type", F.lit(None).cast(rules.schema["desc_needles"].dataType).alias("desc_needles")))


def classify_by_table(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``classify`` with the rules as a table ``(prio, finding_type, kind, needle, desc_needles)``.

    The smallest ``prio`` that matches wins.  Rules are looked up once per rule id, not per finding, and by index, so
    neither many rules nor many findings of one rule cost more than their number; what the ids lead to is joined back
    with the facts of frequent ids broadcast.  Rules that ask for words of the description are tried on each finding
    of an id they meet, if nothing of smaller ``prio`` does.
    """
    rid = F.expr(rule_text("rule_id"))
    desc = F.when(rid.startswith("osv_"), F.lower(F.coalesce("description", F.lit("")))).otherwise("")
    keyed = findings.withColumns({"_rid": rid, "_desc": desc})
    plain_rules = rules.withColumn("desc_needles", F.when((F.col("kind") == "prefix") & (F.size("desc_needles") > 0), F.col("desc_needles")))
    met = _rules_of(keyed.select("_rid").distinct(), plain_rules)
    asks = F.col("desc_needles").isNotNull()
    facts = met.groupBy("_rid").agg(
        F.min(F.when(~asks, F.struct("prio", "finding_type"))).alias("_sure"),
        F.array_sort(F.collect_set(F.when(asks, F.struct("prio", "finding_type", "desc_needles")))).alias("_asking"),
    ).withColumn("_asking", F.filter("_asking", lambda r: F.col("_sure").isNull() | (r["prio"] < F.col("_sure.prio"))))
    joined = join_by_hot_keys(keyed, facts, "_rid")
    told = F.get(F.filter("_asking", lambda r: F.exists(r["desc_needles"], lambda w: F.col("_desc").contains(w))), F.lit(0))["finding_type"]
    resolved = F.coalesce(filled(F.col("finding_type")), told, F.col("_sure.finding_type"), F.lit(controls.DEFAULT_TYPE))
    return joined.withColumn("resolved_type", resolved).select(*findings.columns, "resolved_type")


def preset_cve_types(findings: DataFrame) -> DataFrame:
    """Sets the type of dependency findings from the impact their description states."""
    stated = (
        (F.col("tool") == "osv") & filled(F.col("description")).isNotNull() & filled(F.col("rule_id")).isNotNull()
    )
    return findings.withColumn(
        "finding_type", F.when(stated, cve_subtype(F.col("description"))).otherwise(F.col("finding_type"))
    )


def add_remediation(findings: DataFrame) -> DataFrame:
    """Fills an empty remediation from the type's text; types without one stay NULL."""
    texts = as_df(findings.sparkSession, "remediation").withColumnsRenamed(
        {"finding_type": "resolved_type", "remediation": "_text"}
    )
    return (
        findings.join(F.broadcast(texts), "resolved_type", "left")
        .withColumn("remediation", F.coalesce(filled(F.col("remediation")), "_text"))
        .drop("_text")
    )


def _allowed(framework: Column, kind: Column) -> Column:
    return ~(framework.isin(*controls.PRIVACY_FRAMEWORKS) & kind.isin(*controls.PRIVACY_EXCLUDED_TYPES))


def map_controls(findings: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """All controls of each finding's type, in catalogue order.

    Unknown types take the controls of the default type; excluded types take no
    privacy control.  The own catalogue has fewer than 200 rows and is broadcast;
    how a caller's is joined follows its size.
    """
    edges = F.broadcast(as_df(findings.sparkSession, "control_map")) if catalogue is None else catalogue
    edges = edges.withColumnRenamed("finding_type", "_known")
    return (
        findings.withColumn("_known", known_type(F.col("resolved_type")))
        .join(edges, "_known")
        .drop("_known")
        .where(_allowed(F.col("framework"), F.col("resolved_type")))
    )


def pick_control(controls_of: DataFrame) -> DataFrame:
    """One control per (finding type, framework) of a catalogue: last for SOC 2 / ISO, first for privacy."""
    control = F.struct("control_id", "control_name")
    private = F.col("framework").isin(*controls.PRIVACY_FRAMEWORKS)
    return (
        controls_of.where(_allowed(F.col("framework"), F.col("finding_type")))
        .groupBy("finding_type", "framework")
        .agg(F.when(F.first(private), F.min_by(control, "ord")).otherwise(F.max_by(control, "ord")).alias("c"))
        .select("finding_type", "framework", "c.*")
    )


def _picked(findings: DataFrame, frameworks: Iterable[str]) -> DataFrame:
    picks = as_df(findings.sparkSession, "control_pick").where(F.col("framework").isin(*frameworks))
    edges = F.broadcast(picks.withColumnRenamed("finding_type", "_known"))
    return (
        findings.withColumn("_known", known_type(F.col("resolved_type")))
        .join(edges, "_known")
        .drop("_known")
        .where(_allowed(F.col("framework"), F.col("resolved_type")))
    )


def security_controls(findings: DataFrame) -> DataFrame:
    """SOC 2 and ISO 27001 rows with the template explanation."""
    text = F.format_string(
        SECURITY_TEXT,
        F.coalesce("title", F.lit("")), F.col("control_name"), F.col("control_id"),
    )
    return _picked(findings, ("soc2", "iso27001")).withColumn("explanation", text)


def curated_privacy(findings: DataFrame) -> DataFrame:
    """GDPR and DPDP rows of findings that a curated entry covers."""
    entries = F.broadcast(as_df(findings.sparkSession, "curated"))
    return with_entry(findings).join(entries, "entry")


def with_entry(findings: DataFrame) -> DataFrame:
    """Adds the number of the curated entry that covers a finding."""
    return findings.withColumn("entry", curated_entry())


def fallback_privacy(findings: DataFrame) -> DataFrame:
    """GDPR and DPDP rows from the catalogue, for findings no curated entry covers."""
    text = F.format_string(
        PRIVACY_TEXT,
        F.coalesce("title", F.lit("")), F.col("control_name"), F.col("control_id"),
    )
    rest = with_entry(findings).where("entry is null")
    return _picked(rest, controls.PRIVACY_FRAMEWORKS).withColumn("explanation", text)


def map_privacy(findings: DataFrame) -> DataFrame:
    """Curated and fallback rows together."""
    return _exploded(findings, security=False)


def mapped_controls(findings: DataFrame) -> DataFrame:
    """All mapped rows of classified findings: one per (finding, framework)."""
    return _exploded(findings, security=True)


def _exploded(findings: DataFrame, security: bool) -> DataFrame:
    """``security_controls``, ``curated_privacy`` and ``fallback_privacy`` in one pass.

    The rows of a type and of a curated entry come as arrays, so a finding meets
    each dimension once and is exploded once.
    """
    row = "array<struct<framework string, control_id string, control_name string, text string>>"
    by_type, by_entry = {}, {}
    for kind, *control in controls.chosen_rows():
        by_type.setdefault(kind, []).append((*control, None))
    for entry, *control in privacy.curated_rows():
        by_entry.setdefault(entry, []).append(tuple(control))
    spark = findings.sparkSession
    picks = spark.createDataFrame(list(by_type.items()), f"_known string, _picks {row}")
    curated = spark.createDataFrame(list(by_entry.items()), f"entry int, _curated {row}")

    private = lambda c: c["framework"].isin(*controls.PRIVACY_FRAMEWORKS)
    open_type = ~F.col("resolved_type").isin(*controls.PRIVACY_EXCLUDED_TYPES)
    fallback = F.when(F.col("entry").isNull() & open_type, F.filter("_picks", private))
    chosen = F.coalesce("_curated", fallback, F.array().cast(row))
    if security:
        chosen = F.concat(F.filter("_picks", lambda c: ~private(c)), chosen)
    rows = (
        with_entry(findings)
        .withColumn("_known", known_type(F.col("resolved_type")))
        .join(F.broadcast(picks), "_known")
        .join(F.broadcast(curated), "entry", "left")
        .select(*findings.columns, F.explode(chosen).alias("c"))
    )
    title = F.coalesce("title", F.lit(""))
    template = F.when(
        private(F.col("c")),
        F.format_string(PRIVACY_TEXT, title, F.col("c.control_name"), F.col("c.control_id")),
    ).otherwise(F.format_string(SECURITY_TEXT, title, F.col("c.control_name"), F.col("c.control_id")))
    return rows.select(
        *findings.columns, "c.framework", "c.control_id", "c.control_name",
        F.coalesce("c.text", template).alias("explanation"),
    )


def privacy_flag(findings: DataFrame) -> DataFrame:
    """Audit trail of each finding: stated type, resolved type, has a GDPR row.

    Whether a row exists follows from the entry number and the catalogue, so
    the mapped rows need not be joined back.
    """
    gdpr_types = [row[0] for row in controls.chosen_rows() if row[1] == "gdpr"]
    curated = [row[0] for row in privacy.curated_rows() if row[1] == "gdpr"]
    by_catalogue = F.col("entry").isNull() & known_type(F.col("resolved_type")).isin(*gdpr_types) & _allowed(
        F.lit("gdpr"), F.col("resolved_type")
    )
    return with_entry(findings).select(
        "repo_id", "src_ord", "pos", "rule_id",
        or_else(F.col("finding_type"), "unset").alias("raw_type"),
        "resolved_type",
        (F.coalesce(F.col("entry").isin(*curated), F.lit(False)) | by_catalogue).alias("has_gdpr"),
    )


def attach_regulation(mapped: DataFrame, chunks: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Regulation text of each row's control, or NULL.

    Only chunks whose id is a catalogue control are taken, one per id, so the
    broadcast side is bounded by the catalogue whatever the size of the corpus.
    The whole text is returned, or its first ``max_chars``.
    """
    text = F.col("content") if max_chars is None else F.left("content", F.lit(max_chars))
    ids = sorted({row[3] for row in controls.control_rows()})
    texts = (
        chunks.where(F.col("id").isin(*ids))
        .groupBy("id")
        .agg(F.max(text).alias("regulation"))
        .withColumnRenamed("id", "control_id")
    )
    return mapped.join(F.broadcast(texts), "control_id", "left")


def attach_explanations(mapped: DataFrame, written: DataFrame, require_explanation: bool = False) -> DataFrame:
    """Written explanations ``(rule_id, framework, explanation)`` joined back by rule id, of which one may hold any share.

    Rows without one keep the template text, or are dropped when
    ``require_explanation`` is set.
    """
    texts = (
        written.where("explanation <> ''")
        .groupBy("rule_id", "framework")
        .agg(F.max("explanation").alias("_text"))
    )
    joined = join_by_hot_keys(mapped, texts, ["rule_id", "framework"], "inner" if require_explanation else "left")
    return joined.withColumn("explanation", F.coalesce("_text", "explanation")).drop("_text")


def explain(
    mapped: DataFrame, writer: Callable[[list[dict]], list[str]] | None = None, batch: int = 5
) -> DataFrame:
    """Explanations by a caller's writer, in batches inside the tasks.

    Without a writer the template stays.  When a batch fails its items are tried
    one by one, and an item that fails keeps the template.
    """
    if writer is None:
        return mapped
    schema = mapped.schema

    def write(frames):
        for frame in frames:
            items = frame[["rule_id", "title", "description", "framework", "control_id", "control_name"]]
            items = items.to_dict("records")
            texts = []
            for start in range(0, len(items), batch):
                part = items[start:start + batch]
                try:
                    answer = writer(part)
                    if len(answer) != len(part):
                        raise ValueError("one text per item expected")
                except Exception:
                    answer = []
                    for item in part:
                        try:
                            answer.append(writer([item])[0])
                        except Exception:
                            answer.append(None)
                texts += answer
            kept = frame["explanation"].tolist()
            yield frame.assign(explanation=[t or old for t, old in zip(texts, kept)])

    return mapped.mapInPandas(write, schema)
