"""Constant dimensions, as Python values, as DataFrames and as SQL ``VALUES`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import controls, privacy, remediation, rules, tools

TABLES = {
    "control_map": (
        "finding_type string, ord int, framework string, control_id string, control_name string",
        controls.control_rows,
    ),
    "control_pick": (
        "finding_type string, framework string, control_id string, control_name string",
        controls.chosen_rows,
    ),
    "remediation": ("finding_type string, remediation string", remediation.remediation_rows),
    "class_rules": (
        "prio int, finding_type string, kind string, needle string, desc_needles array<string>",
        rules.rule_rows,
    ),
    "curated": (
        "entry int, framework string, control_id string, control_name string, explanation string",
        privacy.curated_rows,
    ),
    "frameworks": (
        "fw_ord int, framework string",
        lambda: list(enumerate(controls.FRAMEWORKS)),
    ),
    "content_patterns": (
        "rule_no int, rule_id string, severity string, title string, test string, pattern string",
        lambda: [(i, *row) for i, row in enumerate(tools.CONTENT_PATTERNS)],
    ),
}


def as_df(spark: SparkSession, name: str) -> DataFrame:
    """A constant dimension as a DataFrame; every table here has fewer than 200 rows."""
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows(), schema)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(sql_literal(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows, columns: str) -> str:
    """Rows as ``(VALUES ...) AS t(columns)`` text for an SQL engine."""
    body = ",\n".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


def as_values_sql(name: str) -> str:
    """A constant dimension as a SQL derived table with the same column names."""
    schema, rows = TABLES[name]
    columns = ", ".join(part.strip().split(" ")[0] for part in schema.split(", "))
    return f"(SELECT * FROM {values_sql(rows(), columns)})"
