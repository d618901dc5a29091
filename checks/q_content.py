"""Text scan, regulation corpus, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import content, corpus, mapping
from auditloom.operators.data_fields import carry_model
from auditloom.session import new_folder
from auditloom.sources import regulation, store

from . import oracle as O
from .derived import dealt, view
from .q_audit import document_texts, mapped_rows, MAPPED
from .registry import check

HITS = O.content_hits("hits")


@check("content_scan_counts", O.with_(HITS) + """
    SELECT source AS repo_id, rule_id, count(*) AS files, CAST(sum(n) AS BIGINT) AS hits FROM hits GROUP BY 1, 2""")
def content_scan_counts(spark, sf):
    hits = content.content_scan(document_texts(spark, sf))
    return hits.groupBy("repo_id", "rule_id").agg(F.count("*").alias("files"), F.sum("n").alias("hits"))


@check("content_scan_findings", O.with_(HITS) + """
    SELECT source AS repo_id, doc_id AS pos, 'secrets' AS tool, severity, title,
           title || ' found ' || n || ' time(s) in docs/' || doc_id || '.txt' AS description,
           'docs/' || doc_id || '.txt' AS file_path, rule_id FROM hits""")
def content_scan_findings(spark, sf):
    return content.content_findings(content.content_scan(document_texts(spark, sf)))


# --------------------------------------------------------------------------- segmentation

TURNS = """
    v AS (SELECT conv_id AS doc_id, turn AS line_no, role, text AS line FROM conversations),
    s AS (SELECT *, max(CASE WHEN role = 'user' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS start_line FROM v)"""


@check("segment_articles", O.with_(TURNS) + """
    SELECT doc_id, start_line, arg_min(line, line_no) AS heading, count(*) AS n_lines,
           string_agg(line, chr(10) ORDER BY line_no) AS content
    FROM s WHERE start_line IS NOT NULL GROUP BY 1, 2""")
def segment_articles(spark, sf):
    """Conversations cut at the user's turns."""
    turns = view(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "role", F.col("text").alias("line")
    )
    return regulation.segment(turns, F.col("role") == "user", block_rows=4)


# Each page becomes a regulation page: two articles and two numbered rules around its own text.
PAGE_TEXT = (
    "'<h2>Article ' || CAST(page_id % 120 AS STRING) || '</h2>' || html || '<p>Article ' || CAST(page_id % 7 AS STRING) "
    "|| '</p><p>' || CAST(page_id % 5 AS STRING) || '. First rule</p>' || url || '<p>' || CAST(page_id % 5 AS STRING) || '. Again</p>end'"
)


def _page_docs(spark, sf):
    pages = dealt(view(spark, sf, "pages"), "page_id")
    return pages.select(F.col("page_id").alias("doc_id"), F.expr(PAGE_TEXT).alias("content"))


ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
PAGE_LINES = f"""
    pt AS (SELECT page_id AS doc_id, {ENTITIES.format(
        "regexp_replace(regexp_replace(" + PAGE_TEXT + ", '(?is)<script[ >].*?</script *>|<style[ >].*?</style *>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g')")} AS t FROM pages),
    pl0 AS (SELECT doc_id, t, unnest(range(len(str_split_regex(t, '\\r\\n|\\r|\\n')))) AS line_no FROM pt),
    pl AS (SELECT doc_id, line_no, regexp_replace(str_split_regex(t, '\\r\\n|\\r|\\n')[line_no + 1], '^\\s+|\\s+$', '', 'g') AS line FROM pl0),
    lines AS (SELECT * FROM pl WHERE line <> '')"""


def _segments(name: str, pattern: str) -> str:
    return f"""
    {name}_m AS (SELECT *, max(CASE WHEN regexp_matches(line, '{pattern}') THEN line_no END)
        OVER (PARTITION BY doc_id ORDER BY line_no) AS start_line FROM lines),
    {name}_s AS (SELECT doc_id, start_line, arg_min(line, line_no) AS heading, string_agg(line, chr(10) ORDER BY line_no) AS content
        FROM {name}_m WHERE start_line IS NOT NULL GROUP BY 1, 2),
    {name} AS (SELECT *, TRY_CAST(regexp_extract(heading, '{pattern}', 1) AS BIGINT) AS number FROM {name}_s)"""


CHUNKS = f"""{PAGE_LINES}, {_segments("art", regulation.ARTICLE)}, {_segments("rul", regulation.RULE)},
    chunks AS (
        SELECT doc_id, start_line, 'gdpr_article_' || number AS id, content, 'gdpr' AS framework FROM art WHERE number BETWEEN 1 AND 99
        UNION ALL
        SELECT doc_id, start_line, 'dpdp_rule_' || number, content, 'dpdp' FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY start_line) AS k FROM rul) WHERE k = 1)"""


def _chunks(spark, sf):
    lines = regulation.regulation_lines(_page_docs(spark, sf))
    return regulation.segment_articles(lines).unionByName(regulation.segment_rules(lines))


@check("regulation_lines", O.with_(PAGE_LINES) + " SELECT doc_id, line_no, line FROM lines")
def regulation_lines(spark, sf):
    return regulation.regulation_lines(_page_docs(spark, sf))


@check("regulation_chunks", O.with_(CHUNKS) + " SELECT doc_id, start_line, id, framework, content FROM chunks")
def regulation_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "start_line", "id", "framework", "content")


LATEST_CHUNKS = """
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) AS k FROM chunks) WHERE k = 1)"""


@check("regulation_join", O.with_(*MAPPED, CHUNKS, LATEST_CHUNKS) + """
    SELECT m.repo_id, m.src_ord, m.pos, m.framework, m.control_id, n.content AS regulation
    FROM m LEFT JOIN newest n ON n.id = m.control_id""")
def regulation_join(spark, sf):
    chunks = _chunks(spark, sf).select("id", "content", "doc_id")
    newest = store.upsert(chunks.where("doc_id < 0"), chunks, "id", "doc_id")
    return mapping.attach_regulation(mapped_rows(spark, sf), newest).select(
        "repo_id", "src_ord", "pos", "framework", "control_id", "regulation"
    )


CLASS_LINE = "^class ([A-Za-z0-9]+)"


@check("carry_model", """
    WITH v AS (SELECT CAST(conv_id AS STRING) AS source_file, turn AS line_no,
                      CASE WHEN role = 'user' THEN 'class C' || turn || ':' ELSE text END AS line FROM conversations),
    n AS (SELECT *, max(CASE WHEN regexp_matches(line, '^class ([A-Za-z0-9]+)') THEN line_no END)
                 OVER (PARTITION BY source_file ORDER BY line_no) AS headed FROM v)
    SELECT source_file, line_no, CASE WHEN headed IS NOT NULL THEN 'C' || headed END AS model FROM n""")
def carried_model(spark, sf):
    lines = view(spark, sf, "conversations").select(
        F.lit("r").alias("repo_id"), F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("line_no"),
        F.when(F.col("role") == "user", F.concat(F.lit("class C"), F.col("turn").cast("string"), F.lit(":")))
        .otherwise(F.col("text")).alias("line"),
    )
    return carry_model(lines, CLASS_LINE).select("source_file", "line_no", "model")


# --------------------------------------------------------------------------- vectors

def _vectors(spark, sf):
    return view(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("framework"), "embedding"
    )


@check("match_chunks", """
    WITH cells AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY 1, 2),
    q AS (SELECT label, list(m ORDER BY i) AS qv FROM means GROUP BY 1),
    s AS (SELECT CAST(q.label AS STRING) AS query_id, e.vec_id AS id,
                 list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.qv) AS sim
          FROM embeddings e JOIN q ON q.label = e.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 3""")
def match_chunks(spark, sf):
    """For each framework the three chunks nearest to its mean vector."""
    chunks = _vectors(spark, sf)
    # One row per framework, stored so that counting and sending it does not read the chunks again.
    path = new_folder(spark, "centroids")
    corpus.framework_centroids(chunks).write.parquet(path)
    queries = spark.read.parquet(path)
    return corpus.match_chunks(queries, chunks, 3).select(
        "query_id", "id", "rank", F.round("similarity", 6).alias("similarity")
    )


@check("match_chunks_many", """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(c.e, q.e) AS sim FROM v q JOIN v c ON c.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM s)
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity, 'chunk ' || id AS content FROM r WHERE rank <= 3""")
def match_chunks_many(spark, sf):
    """For every vector the three nearest of its framework, with their text."""
    chunks = _vectors(spark, sf).withColumn("content", F.concat(F.lit("chunk "), F.col("id").cast("string")))
    queries = chunks.select(F.col("id").alias("query_id"), "framework", "embedding")
    return corpus.match_chunks(queries, chunks, 3).select(
        "query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), "content"
    )


@check("embed_chunks", """
    SELECT 'doc_' || doc_id AS id, lang AS framework, CAST(length(text) AS DOUBLE) AS chars,
           CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks,
           CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM documents""")
def embed_chunks(spark, sf):
    """Encoder hook over whole documents, with an encoder that only counts."""

    def make_encoder():
        return lambda texts: [[len(t), t.count(" "), t.count("e")] for t in texts]

    docs = view(spark, sf, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"),
        F.col("lang").alias("framework"),
    )
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return corpus.embed_chunks(docs, make_encoder).withColumn("v", cells).select(
        "id", "framework", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("chars", "blanks", "es"))]
    )
