"""Readers of static-analysis and infrastructure reports, schema files, workflow files, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditloom.operators import infrastructure
from auditloom.session import new_folder
from auditloom.sources import files as src_files, reports, schema_files as sfiles, store

from . import oracle as O
from .derived import FIELD_NAMES, FIELD_TYPES, dealt, view
from .registry import check

# --------------------------------------------------------------------------- reports

LEVELS = ["ERROR", "Warning", "INFO", "inventory", "experiment"]


def _sast_reports(spark, sf):
    """One report per event: two results, the second without severity and message."""
    e = dealt(view(spark, sf, "events"), "event_id")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("event_id") % len(LEVELS) + 1).cast("int"))
    result = lambda cid, lev, msg: F.struct(
        cid.alias("check_id"), F.concat(F.lit("src/"), "event_type").alias("path"),
        F.struct(lev.alias("severity"), msg.alias("message")).alias("extra"))
    none = F.lit(None).cast("string")
    report = F.struct(F.array(
        result(F.concat(F.lit("rule."), "event_type"), level, F.col("props")), result(F.lit("rule.bare"), none, none),
    ).alias("results"))
    return e.select(F.col("user_id").cast("string").alias("repo_id"), F.col("event_id").alias("report_no"), F.to_json(report).alias("report"))


@check("sast_from_json", f"""
    WITH e AS (SELECT *, {O.sql_list(LEVELS)}[event_id % {len(LEVELS)} + 1] AS level FROM events)
    SELECT CAST(user_id AS STRING) AS repo_id, event_id * 1073741824 AS pos, 'semgrep' AS tool,
           CASE lower(level) WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'high' WHEN 'inventory' THEN 'low' WHEN 'info' THEN 'low' ELSE 'medium' END AS severity,
           'rule.' || event_type AS title, props AS description, 'src/' || event_type AS file_path, 'rule.' || event_type AS rule_id FROM e UNION ALL
    SELECT CAST(user_id AS STRING), event_id * 1073741824 + 1, 'semgrep', 'high', 'rule.bare', '', 'src/' || event_type, 'rule.bare' FROM e""")
def sast_from_json(spark, sf):
    return reports.sast_findings(_sast_reports(spark, sf))


# check id, name, level, guideline, resource
CHECKS = [
    ("CKV_DOCKER_2", "Ensure that HEALTHCHECK instructions have been added", "LOW", "https://docs/1", "Dockerfile."),
    ("CKV_DOCKER_3", "Ensure that a user for the container has been created", None, None, "Dockerfile."),
    ("CKV_S3_20", "S3 Bucket allows public READ", "MEDIUM", "https://docs/2", "aws_s3_bucket.b"),
    ("CKV_S3_18", "Ensure access logs are on", "high", None, None),
    ("CKV_SG_24", "Ensure no ingress from 0.0.0.0:0 to port 22", "low", "", "aws_security_group.g"),
    ("CKV_EKS_39", "Ensure public endpoint is off", "CRITICAL", None, "aws_eks_cluster.c"),
    ("CKV_KMS_7", "Ensure rotation is on", "moderate", None, "aws_kms_key.k"),
    ("CKV_CLOUDTRAIL_1", "Ensure trail covers regions", "odd", None, "aws_cloudtrail.t"),
    ("CKV_AWS_53", None, None, None, None),
]
CHECK_FIELDS = ["check_id", "check_name", "severity", "guideline", "resource"]


def _iac_reports(spark, sf):
    """One report per page in all report shapes: object, list, array of reports, no results."""
    checks = spark.createDataFrame([(i, *row) for i, row in enumerate(CHECKS)], "i int, " + ", ".join(f"{c} string" for c in CHECK_FIELDS))
    p = view(spark, sf, "pages").withColumn("i", (F.col("page_id") % len(CHECKS)).cast("int")).join(F.broadcast(checks), "i")
    path = F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.lit(".tf"))
    one = F.to_json(F.struct(
        *CHECK_FIELDS, F.when(F.col("page_id") % 2 == 0, path).alias("repo_file_path"), F.lit("/other").alias("file_path")))
    wrap = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    shape = F.col("page_id") % 6
    report = (
        F.when(shape == 0, wrap('{"results":{"failed_checks":[', one, ']}}'))
        .when(shape == 1, wrap('{"results":[', one, ',"text",5]}'))
        .when(shape == 2, F.concat(F.lit('[{"results":{"failed_checks":['), one, F.lit(']}},"skip",{"results":{"failed_checks":['), one, F.lit(']}}]')))
        .when(shape == 3, wrap('{"results":null,"failed_checks":[', one, ']}'))
        .when(shape == 4, wrap('{"failed_checks":[', one, ']}'))
        .otherwise(wrap('{"results":{"failed_checks":[', one, ''))
    )
    return p.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("repo_id"), F.col("page_id").alias("report_no"), report.alias("report"))


def _c(col):
    return f"coalesce({col}, '')"


def _has(col, *words):
    return "(" + " OR ".join(f"contains(lower({_c(col)}), '{w}')" for w in words) + ")"


IAC_CHECKS = f"""
    chk AS (SELECT * FROM {O.values_list([(i, *row) for i, row in enumerate(CHECKS)], "i, check_id, check_name, severity, guideline, resource")}),
    page AS (SELECT split_part(url, '/', 3) AS repo_id, page_id, page_id % 6 AS shape, c.*,
             CASE WHEN page_id % 2 = 0 THEN '/p' || page_id || '.tf' ELSE '/other' END AS file_path
             FROM pages p JOIN chk c ON p.page_id % {len(CHECKS)} = c.i),
    got AS (SELECT *, page_id * 1073741824 AS pos FROM page WHERE shape IN (0, 1, 2, 3)
            UNION ALL SELECT *, page_id * 1073741824 + 1 FROM page WHERE shape = 2)"""
IAC_COLUMNS = ["repo_id", "pos", "severity", "title", "description", "file_path", "rule_id", "finding_type"]


@check("iac_from_json", O.with_(IAC_CHECKS) + f"""
    SELECT repo_id, pos, CASE WHEN ({_has('check_name', 'public')} AND {_has('check_name', 'bucket')}) OR contains({_c('check_name')}, '0.0.0.0') THEN 'high'
             WHEN lower({_c('severity')}) IN ('critical', 'high') THEN 'high' WHEN lower({_c('severity')}) = 'low' THEN 'low' ELSE 'medium' END AS severity,
           'IaC: ' || check_id AS title,
           {_c('check_name')} || ' — ' || {_c('resource')} || ' (in ' || file_path || '). Guideline: '
             || CASE WHEN {_c('guideline')} = '' THEN 'N/A' ELSE guideline END AS description,
           file_path, 'checkov_' || check_id AS rule_id,
           CASE WHEN {_has('check_id', 'docker')} AND ({_has('check_name', 'healthcheck')} OR check_id LIKE '%\\_2' ESCAPE '\\') THEN 'iac_docker_healthcheck'
                WHEN {_has('check_id', 'docker')} AND ({_has('check_name', 'user', 'root')} OR check_id LIKE '%\\_3' ESCAPE '\\') THEN 'iac_docker_user'
                WHEN {_has('check_id', 's3')} AND {_has('check_name', 'public', 'acl', 'policy', 'versioning', 'encryption')} THEN 'iac_storage_misconfigured'
                WHEN {_has('check_id', 's3')} AND {_has('check_name', 'log')} THEN 'iac_logging_missing'
                WHEN {_has('check_id', 'sg', 'security_group', 'network', 'cidr')} AND {_has('check_name', '0.0.0.0', 'any', 'open', 'public')} THEN 'iac_network_exposed'
                WHEN {_has('check_id', 'eks')} AND {_has('check_name', 'public')} THEN 'iac_network_exposed'
                WHEN {_has('check_id', 'encrypt', 'kms', 'key', 'ssl', 'tls')} THEN 'iac_encryption_missing'
                WHEN {_has('check_id', 'log', 'cloudtrail', 'monitor', 'audit')} THEN 'iac_logging_missing'
                ELSE 'iac_storage_misconfigured' END AS finding_type
    FROM got""")
def iac_from_json(spark, sf):
    return infrastructure.iac_findings(reports.iac_checks(_iac_reports(spark, sf))).select(*IAC_COLUMNS)


# --------------------------------------------------------------------------- schema definitions

# Each event becomes one definition file of model M<event_id> with three fields.
def _field(k: int) -> str:
    return f"{O.sql_list(FIELD_NAMES)}[CAST((event_id * {k} + {k}) % {len(FIELD_NAMES)} AS INT) + 1]"


def _type(k: int) -> str:
    return f"{O.sql_list(FIELD_TYPES)}[CAST((event_id + {k}) % {len(FIELD_TYPES)} AS INT) + 1]"


def _parts(spark, sf, path: str) -> DataFrame:
    names = F.array(*map(F.lit, FIELD_NAMES))
    types = F.array(*map(F.lit, FIELD_TYPES))
    columns = {}
    for k in (1, 5, 7):
        columns[f"n{k}"] = F.get(names, ((F.col("event_id") * k + k) % len(FIELD_NAMES)).cast("int"))
        columns[f"t{k}"] = F.get(types, ((F.col("event_id") + k) % len(FIELD_TYPES)).cast("int"))
    return dealt(view(spark, sf, "events"), "event_id").withColumns(columns).withColumns({
        "repo_id": F.col("user_id").cast("string"), "path": F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(path)),
        "m": F.concat(F.lit("M"), F.col("event_id").cast("string")),
    })


def _text(*parts) -> F.Column:
    """Text of columns (names in braces) and constants."""
    return F.concat(*[F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts])


def _flat(path: str, rows, which: str = "true") -> str:
    """The fields of the definition files, stated directly: (k, field_type, line, comment) per field."""
    selects = [
        f"SELECT CAST(user_id AS STRING) AS repo_id, 'f' || event_id || '{path}' AS source_file, {model} AS model, "
        f"{_field(k)} AS name, {kind} AS field_type, {line} AS line_number, {comment} AS comment FROM events WHERE {which}"
        for model, k, kind, line, comment in rows
    ]
    return " UNION ALL ".join(selects)


OUT = ["repo_id", "source_file", "model", "name", "field_type", "line_number", "comment"]
MODEL = "'M' || event_id"


KINDS: list[tuple] = []


def _register(kind: str, extract, path: str, text, rows):
    KINDS.append(("sql_migration" if kind == "sql_ddl" else kind, path, text, rows))

    @check(f"schema_fields_{kind}", _flat(path, rows))
    def job(spark, sf):
        files = _parts(spark, sf, path).select("repo_id", "path", text().alias("content"))
        return extract(files).select(*OUT)

    return job


_register(
    "prisma", sfiles.fields_prisma, ".prisma",
    lambda: _text("// head\nmodel ", "{m}", " {\n  ", "{n1}", " ", "{t1}", " @id\n  // note\n\n  ", "{n5}", "  ", "{t5}", "@unique  // main value\n  lonely\n  ",
                  "{n7}", " ", "{t7}", "\n}\n"),
    [(MODEL, 1, _type(1), 0, "''"), (MODEL, 5, _type(5), 0, "'main value'"), (MODEL, 7, _type(7), 0, "''")],
)
_register(
    "python_orm", sfiles.fields_python_orm, "/models.py",
    lambda: _text("import db\n\nclass ", "{m}", "(models.Model):\n    ", "{n1}", " = Column(", "{t1}", ")  # first\n    # ", "{n1}", " = Column(X)\n    ",
                  "{n5}", " = models.CharField(", "{t5}", ")\n\nBase = declarative_base()\n    ", "{n7}", " = db.Column( ", "{t7}", ", nullable=False)\n"),
    [(MODEL, 1, _type(1), 4, "'first'"), (MODEL, 5, _type(5), 6, "''"), ("'Base'", 7, _type(7), 9, "''")],
)
_register(
    "typeorm", sfiles.fields_typeorm, ".entity.ts",
    lambda: _text("@Entity('a')\nexport class ", "{m}", " {\n  @Column({ nullable: true })\n  ", "{n1}", ": ", "{t1}", ";\n}\n@Entity()\nclass ", "{m}", "B {\n  @Column()\n  ",
                  "{n5}", ": ", "{t5}", ";\n  plain: string;\n  @Column()\n  ", "{n7}", ": ", "{t7}", ";\n}\n"),
    [(MODEL, 1, _type(1), 0, "''"), (MODEL + " || 'B'", 5, _type(5), 0, "''"), (MODEL + " || 'B'", 7, _type(7), 0, "''")],
)
_register(
    "mongoose", sfiles.fields_mongoose, ".schema.js",
    lambda: _text("const ", "{m}", " = new Schema({\n  ", "{n1}", ": String,\n  // ", "{n7}", ": no\n  ", "{n5}", ": Number,\n  ", "{n7}", ": Date\n});\n"),
    [(MODEL + " || 'Schema'", k, "'object'", 0, "''") for k in (1, 5, 7)],
)
_register(
    "graphql", sfiles.fields_graphql, ".graphql",
    lambda: _text("type ", "{m}", " {\n  ", "{n1}", ": ", "{t1}", "! # shown\n  # ", "{n5}", "\n  _hidden: Int\n  ", "{n5}", ": ", "{t5}", "\n}\ninterface ", "{m}", "I {\n  ",
                  "{n7}", ": ", "{t7}", "\n}\n"),
    [(MODEL, 1, _type(1) + " || '!'", 0, "'shown'"), (MODEL, 5, _type(5), 0, "''"), (MODEL + " || 'I'", 7, _type(7), 0, "''")],
)
_register(
    "sql_ddl", sfiles.fields_sql_ddl, ".sql",
    lambda: _text("create table if not exists app.", "{m}", " (\n  \"", "{n1}", "\" ", "{t1}", ",\n  -- remark\n  PRIMARY KEY (id),\n  `", "{n5}", "` ", "{t5}",
                  " -- kept\n  constraint c CHECK (x),\n  ", "{n7}", " ", "{t7}", " NOT NULL\n);\n"),
    [(MODEL, 1, _type(1), 0, "''"), (MODEL, 5, _type(5), 0, "'kept'"), (MODEL, 7, _type(7), 0, "''")],
)


@check("schema_models_openapi", """
    SELECT CAST(user_id AS STRING) AS repo_id, 'f' || event_id || '/openapi.yaml' AS source_file, 'M' || event_id AS model FROM events UNION ALL
    SELECT CAST(user_id AS STRING), 'f' || event_id || '/openapi.yaml', 'Other' FROM events""")
def schema_models_openapi(spark, sf):
    text = _text("openapi: 3.0.0\ncomponents:\n  schemas:\n    ", "{m}", ":\n      type: object\n    Other:\n      type: string\npaths:\n  /x:\n    get: {}\n")
    files = _parts(spark, sf, "/openapi.yaml").select("repo_id", "path", text.alias("content"))
    return sfiles.models_openapi(files).select("repo_id", "source_file", "model")


@check("schema_fields", " UNION ALL ".join(
    f"SELECT * FROM ({_flat(path, rows, f'event_id % {len(KINDS)} = {i}')})" for i, (_, path, _, rows) in enumerate(KINDS)))
def schema_fields(spark, sf):
    """The extractor registry: files of six kinds in one table, each read by its own extractor."""
    files = None
    for i, (parser, path, text, _) in enumerate(KINDS):
        part = _parts(spark, sf, path).where(F.col("event_id") % len(KINDS) == i)
        part = part.select("repo_id", "path", F.lit(parser).alias("parser"), text().alias("content"))
        files = part if files is None else files.unionByName(part)
    return sfiles.schema_fields(files).select(*OUT)


# --------------------------------------------------------------------------- workflow files

@check("workflow_parse", O.with_(O.inputs("d_steps")) + """
    SELECT repo_id, '.github/workflows/' || replace(wf_name, ' ', '-') || '-' || step_no || '.yaml' AS file_path, wf_name, k.job,
           CAST(k.n AS BIGINT) AS step_no, CASE k.n WHEN 0 THEN coalesce(run, '') WHEN 1 THEN 'make' ELSE '' END AS run,
           CASE k.n WHEN 0 THEN coalesce(uses, '') WHEN 2 THEN 'actions/upload@v4' ELSE '' END AS uses,
           CASE WHEN k.n = 0 AND env_key IS NOT NULL THEN env_key || '=' || env_value ELSE '' END AS env
    FROM d_steps, (VALUES (0, 'first'), (1, 'first'), (2, 'second')) AS k(n, job) WHERE d_steps.step_no % 5 <> 4""")
def workflow_parse(spark, sf):
    """One workflow file per step row, written as YAML text; every fifth is damaged."""
    quoted = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    value = lambda name: F.regexp_extract(quoted(F.col(name)), r'^\{"v":(.*)\}$', 1)
    env = F.when(F.col("env_key").isNotNull(), F.concat(F.lit("        env:\n          "), "env_key", F.lit(": "), value("env_value"), F.lit("\n"))).otherwise("")
    damaged = F.when(F.col("step_no") % 5 == 4, "  - : [\n").otherwise("")
    text = F.concat(
        F.lit("name: "), "wf_name", F.lit("\non: [push]\njobs:\n  first:\n    steps:\n      - run: "), value("run"),
        F.lit("\n        uses: "), value("uses"), F.lit("\n"), env, F.lit("      - run: make\n  second:\n    steps:\n      - uses: actions/upload@v4\n  third: text\n"), damaged,
    )
    path = F.concat(F.lit(".github/workflows/"), F.replace("wf_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("step_no").cast("string"), F.lit(".yaml"))
    files = view(spark, sf, "d_steps").select("repo_id", path.alias("path"), text.alias("content"))
    pairs = F.transform(F.map_entries("env"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return src_files.workflow_steps(files).select(
        "repo_id", "file_path", "wf_name", "job", "step_no", "run", "uses", F.array_join(pairs, ",").alias("env")
    )


FOLDERS = ["src", "node_modules", "docs", "dist", "lib"]


def _put_pages(pages: DataFrame, root: str) -> None:
    """Writes ``site/<folder>/page=<page>/part-0`` of all pages; rows of a page are its lines.

    Each task writes the files of its pages itself: Spark's writer makes and moves a file in tens of milliseconds.
    """
    store, base = src_files.repo_files.opened(root)

    def write(batches):
        import pyarrow as pa

        out, last = None, None
        for batch in batches:
            for folder, page, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (folder, page) != last:
                    if out:
                        out.close()
                    last, path = (folder, page), f"{base}/site/{folder}/page={page}"
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/part-0")
                out.write((value or "").encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
        if out:
            out.close()

    # The sort brings the rows of a page together.
    pages.sortWithinPartitions("page").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@check("scan_files", f"""
    WITH p AS (SELECT {O.sql_list(FOLDERS)}[page_id % 5 + 1] AS folder, page_id, html FROM pages)
    SELECT 'site' AS repo_id, folder || '/page=' || page_id AS folder, octet_length(encode(html)) + 1 AS size
    FROM p WHERE folder NOT IN ('node_modules', 'dist')""")
def scan_files(spark, sf):
    """Pages written as small text files into a fresh repository folder, then listed."""
    root = new_folder(spark, "files")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("page_id") % 5 + 1).cast("int"))
    pages = view(spark, sf, "pages").select(folder.alias("folder"), F.col("page_id").alias("page"), F.col("html").alias("value"))
    named = F.coalesce(F.col("page").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    _put_pages(dealt(pages.where("folder IS NOT NULL").withColumn("page", named), "page"), root)
    listed = src_files.scan_files(spark, root, with_content=False).where(r"path rlike '/part-[^/]*$'")
    return listed.select("repo_id", F.regexp_replace("path", r"/part-[^/]*$", "").alias("folder"), "size")


# --------------------------------------------------------------------------- stored tables

AS_OF = "2024-01-30 12:00:00"


def _cache(spark, sf):
    return view(spark, sf, "d_cache").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


LATEST = f"""{O.inputs("d_cache")},
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) AS k FROM d_cache) WHERE k = 1),
    aged AS (SELECT *, TIMESTAMP '{AS_OF}' - created_at <= CASE WHEN starts_with(cache_key, 'fb_') THEN INTERVAL 5 MINUTE ELSE INTERVAL 24 HOUR END AS fresh FROM latest)"""


def _latest_cache(spark, sf):
    rows = _cache(spark, sf)
    return store.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "cache_key", "created_at")


@check("upsert_latest", O.with_(LATEST) + " SELECT cache_key, report, event_id FROM latest")
def upsert_latest(spark, sf):
    return _latest_cache(spark, sf).select("cache_key", "report", "event_id")


@check("cache_fresh", O.with_(LATEST) + """
    SELECT k.cache_key, a.report FROM (SELECT DISTINCT cache_key FROM d_cache) k
    LEFT JOIN aged a ON a.cache_key = k.cache_key AND a.fresh""")
def cache_fresh(spark, sf):
    keys = _cache(spark, sf).select("cache_key").distinct()
    return store.cache_lookup(_latest_cache(spark, sf), keys, F.lit(AS_OF).cast("timestamp_ntz")).select("cache_key", "report")


@check("cache_purge", O.with_(LATEST) + " SELECT cache_key, report FROM aged WHERE fresh")
def cache_purge(spark, sf):
    return store.purge_stale(_latest_cache(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")).select("cache_key", "report")


@check("cache_purge_count", O.with_(LATEST) + " SELECT count(*) FILTER (NOT fresh) AS purged, count(*) FILTER (fresh) AS kept FROM aged")
def cache_purge_count(spark, sf):
    return store.stale_count(_latest_cache(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"))
