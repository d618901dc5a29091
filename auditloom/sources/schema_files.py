"""Schema definitions to ``schema_fields`` rows.

Every extractor is a chain of row-local expressions: a file is split into model
blocks and lines inside its row and exploded, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import tools
from ..functions.text import strip
from ..schemas import SCHEMA_FIELD_COLUMNS

MARK = "\u0001"  # block separator that cannot occur in source text


def _blocks(files: DataFrame, pattern: str) -> DataFrame:
    """One row per match of a (name, body) pattern."""
    found = files.select(
        "repo_id", F.col("path").alias("source_file"),
        F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("model_pos", "block"),
    )
    return found.select(
        "repo_id", "source_file", "model_pos",
        F.regexp_extract("block", pattern, 1).alias("model"),
        F.regexp_extract("block", pattern, 2).alias("body"),
    )


def _lines(blocks: DataFrame) -> DataFrame:
    """One row per non-empty line of a block, with the white-space separated parts."""
    return (
        blocks.select("*", F.posexplode(F.split(strip(F.col("body")), "\n")).alias("field_pos", "line"))
        .withColumn("text", strip(F.col("line")))
        .where("text <> ''")
        .withColumn("parts", F.split("text", r"\s+"))
    )


def _comment(line: str, mark: str) -> Column:
    """What follows the first comment mark of a line, or an empty string."""
    return strip(F.regexp_extract(line, f"(?s){mark}(.*)$", 1))


def _fields(rows: DataFrame, name, field_type, comment=None, line_number=None) -> DataFrame:
    return rows.select(
        "repo_id", "source_file", "model", "model_pos", "field_pos",
        name.alias("name"),
        field_type.alias("field_type"),
        (F.lit(0) if line_number is None else line_number).cast("int").alias("line_number"),
        (F.lit("") if comment is None else comment).alias("comment"),
    ).select(*SCHEMA_FIELD_COLUMNS)


def fields_prisma(files: DataFrame) -> DataFrame:
    rows = _lines(_blocks(files, r"model\s+(\w+)\s*\{([^}]*)\}"))
    rows = rows.where(~F.col("text").rlike("^(?://|#)") & (F.size("parts") >= 2))
    kind = strip(F.regexp_replace(F.get("parts", F.lit(1)), r"@\w+.*", ""))
    return _fields(rows, F.get("parts", F.lit(0)), kind, _comment("text", "//"))


def fields_python_orm(files: DataFrame) -> DataFrame:
    """Classes with the word ``Model`` open a model; column assignments are its fields."""
    head = r"^\s*(?:class\s+(\w+).*?\bModel\b|\w+\s*=\s*declarative_base\(\))"
    assign = r"^(\w+)\s*=\s*(?:db\.\w*Column|Column|models\.\w+)\s*\(\s*(\w+)"
    # Number the lines and mark the headings first, then cut the file at the marks:
    # each block knows its model and every line keeps its number.
    numbered = F.transform(
        F.split("content", "\n"),
        lambda text, i: F.concat(
            F.when(text.rlike(head), MARK).otherwise(""), (i + 1).cast("string"), F.lit("\t"), text
        ),
    )
    blocks = files.select(
        "repo_id", F.col("path").alias("source_file"),
        F.posexplode(F.split(F.array_join(numbered, "\n"), MARK)).alias("model_pos", "block"),
    ).where("model_pos > 0")
    lines = blocks.select(
        "repo_id", "source_file", "model_pos",
        F.regexp_extract(F.regexp_replace(F.split_part("block", F.lit("\n"), F.lit(1)), r"^\d+\t", ""), head, 1)
        .alias("class_name"),
        F.posexplode(F.split("block", "\n")).alias("field_pos", "numbered"),
    ).where("field_pos > 0").withColumns({
        "model": F.when(F.col("class_name") == "", "Base").otherwise(F.col("class_name")),
        "line_no": F.regexp_extract("numbered", r"^(\d+)\t", 1),
        "line": F.regexp_replace("numbered", r"^\d+\t", ""),
    }).withColumn("text", strip(F.col("line")))
    rows = lines.where(~F.col("text").rlike('^(?:#|""")') & F.col("text").rlike(assign))
    return _fields(
        rows,
        F.regexp_extract("text", assign, 1),
        F.regexp_extract("text", assign, 2),
        _comment("line", "#"),
        F.col("line_no"),
    )


def fields_typeorm(files: DataFrame) -> DataFrame:
    """``@Column`` members, scoped to the ``@Entity`` class they follow."""
    head = r"@Entity\([^)]*\)\s*\n\s*(?:export\s+)?class\s+(\w+)"
    column = r"@Column\([^)]*\)\s*\n\s*(\w+)\s*[:=]\s*(\w+)"
    blocks = files.select(
        "repo_id", F.col("path").alias("source_file"),
        F.posexplode(F.split(F.regexp_replace("content", f"({head})", f"{MARK}$1"), MARK))
        .alias("model_pos", "block"),
    ).where("model_pos > 0")
    rows = blocks.select(
        "repo_id", "source_file", "model_pos",
        F.regexp_extract("block", head, 1).alias("model"),
        F.posexplode(F.regexp_extract_all("block", F.lit(column), F.lit(0))).alias("field_pos", "text"),
    )
    return _fields(rows, F.regexp_extract("text", column, 1), F.regexp_extract("text", column, 2))


def fields_mongoose(files: DataFrame) -> DataFrame:
    pattern = (
        r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+Schema\(\s*\{"
        r"([^}]*(?:\{[^}]*\}[^}]*)*)\}\s*[,)]"
    )
    member = r"^(\w+)\s*:\s*(?:\{.*?\}|[^,}]+)"
    rows = _lines(_blocks(files, pattern)).withColumn("model", F.concat("model", F.lit("Schema")))
    rows = rows.where(~F.col("text").startswith("//") & F.col("text").rlike(member))
    return _fields(rows, F.regexp_extract("text", member, 1), F.lit("object"))


def fields_graphql(files: DataFrame) -> DataFrame:
    rows = _lines(_blocks(files, r"(?:type|interface)\s+(\w+)\s*\{([^}]+)\}"))
    rows = rows.where(~F.col("text").rlike("^[#_@]"))
    name = F.regexp_replace(F.get("parts", F.lit(0)), ":$", "")
    return _fields(rows, name, F.coalesce(F.get("parts", F.lit(1)), F.lit("")), _comment("line", "#"))


def fields_sql_ddl(files: DataFrame) -> DataFrame:
    pattern = (
        r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\w+\.)?(\w+)\s*\(([^;]+)\)"
    )
    rows = _lines(_blocks(files, pattern)).withColumn("text", F.regexp_replace("text", ",+$", ""))
    rows = rows.withColumn("parts", F.split("text", r"\s+"))
    words = "|".join(tools.DDL_CONSTRAINT_WORDS)
    rows = rows.where(~F.col("text").rlike(rf"^(?:--|/\*|(?i:{words}))") & (F.size("parts") >= 2))
    name = F.regexp_replace(F.get("parts", F.lit(0)), r'^["`\[\]]+|["`\[\]]+$', "")
    return _fields(rows, name, F.get("parts", F.lit(1)), _comment("line", "--"))


def models_openapi(files: DataFrame) -> DataFrame:
    """Schema names of an API description; the section ends at the first line that is not indented."""
    header = r"(?:schemas|definitions)\s*:\s*\n"
    after = F.regexp_replace("content", rf"(?s)^.*?{header}", "")
    lines = F.split(after, "\n")
    inside = F.transform(lines, lambda x: (x == "") | x.rlike(r"^\s+\w"))
    end = F.array_position(inside, F.lit(False))
    section = F.when(end == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")))
    named = r"^\s+(\w+)\s*:\s*$"
    return (
        files.where(F.col("content").rlike(header))
        .select("repo_id", F.col("path").alias("source_file"), F.posexplode(section).alias("model_pos", "line"))
        .where(F.col("line").rlike(named))
        .select("repo_id", "source_file", F.regexp_extract("line", named, 1).alias("model"), "model_pos")
    )


# Extractors by parser name; a caller may pass a larger registry.
EXTRACTORS = {
    "prisma": fields_prisma,
    "python_orm": fields_python_orm,
    "typeorm": fields_typeorm,
    "mongoose": fields_mongoose,
    "graphql": fields_graphql,
    "sql_migration": fields_sql_ddl,
}


def schema_fields(schema_files: DataFrame, extractors=None) -> DataFrame:
    """Fields of all classified schema files ``(repo_id, path, parser, content)``."""
    result = None
    for parser, extract in (extractors or EXTRACTORS).items():
        part = extract(schema_files.where(F.col("parser") == parser))
        result = part if result is None else result.unionByName(part)
    return result
