"""The registered queries of the corpus operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job):
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A row by id and text, as scratch.row_key().
ROW_SQL = "md5(length(doc_id::varchar) || ':' || doc_id || coalesce(text, ''))"


@query("op2_text_units", f"""
WITH rows AS (SELECT DISTINCT doc_id, {ROW_SQL} AS row_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, row_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM rows),
placed AS (
  SELECT *, (sum(length(line) + 1) OVER (PARTITION BY row_id ORDER BY no) - length(line) - 1)::int AS start,
         trim(regexp_replace(lower(line), '[^\\pL\\pN]+', ' ', 'g')) AS form
  FROM lines
),
ranked AS (
  SELECT *, form <> '' AND row_number() OVER (PARTITION BY form ORDER BY doc_id, row_id, start) > 1 AS gone
  FROM placed
),
whole AS (
  SELECT doc_id, row_id, count(*)::int AS n_units, count(*) FILTER (gone)::int AS n_removed,
         coalesce(string_agg(start || '-' || (start + length(line)), ',' ORDER BY no) FILTER (gone), '') AS removed,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept
  FROM ranked GROUP BY ALL
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       kept AS text
FROM (SELECT doc_id, {ROW_SQL} AS row_id FROM documents) LEFT JOIN whole USING (doc_id, row_id)
""")
def op2_text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat across the documents, gone from all but the earliest."""
    from .text_units import drop_repeated_units

    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return drop_repeated_units(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_units", "n_removed", spans.alias("removed"), "text"
    )


@query("op10_line_windows", f"""
WITH rows AS (SELECT DISTINCT doc_id, {ROW_SQL} AS row_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, row_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM rows),
clean AS (
  SELECT *, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS form FROM lines
),
windows AS (
  SELECT doc_id, row_id, no AS a, lead(no, 1) OVER w AS b, lead(no, 2) OVER w AS c,
         md5(form || chr(10) || lead(form, 1) OVER w || chr(10) || lead(form, 2) OVER w) AS digest
  FROM clean WHERE form <> '' WINDOW w AS (PARTITION BY row_id ORDER BY no)
),
later AS (
  SELECT * FROM windows WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, row_id, a) > 1
),
gone AS (SELECT DISTINCT row_id, unnest([a, b, c]) AS no FROM later),
whole AS (
  SELECT doc_id, row_id, count(*)::int AS n_lines, count(gone.no)::int AS n_removed,
         coalesce(string_agg(gone.no::varchar, ',' ORDER BY lines.no) FILTER (gone.no IS NOT NULL), '') AS removed,
         coalesce(string_agg(line, chr(10) ORDER BY lines.no) FILTER (gone.no IS NULL), '') AS kept
  FROM lines LEFT JOIN gone USING (row_id, no) GROUP BY ALL
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, kept AS text
FROM (SELECT doc_id, {ROW_SQL} AS row_id FROM documents) LEFT JOIN whole USING (doc_id, row_id)
""")
def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines and more that repeat across the documents, gone from all but the earliest."""
    from .line_windows import drop_repeated_windows

    return drop_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text"
    )


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document in a mix of 150% of all words, sources weighing 5, 2, 1, repeating."""
    from .mixing import copies

    made = copies(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return made.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"), "rate", "source",
    )


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


@query("op9_winnowing")
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    from .winnowing import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"), k=16, window=72)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, learned from ``labels``."""
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


@query("op1_near_duplicates")
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_nearest", """
WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    from .nearest import nearest_vectors

    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op4_max_entropy")
def op4_max_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document, learned from nine tenths of them."""
    from .max_entropy import score_texts

    return score_texts(table(spark, sf_dir, "documents"), folds=10)


@query("op3_run_index")
def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its 100-byte strings that start earlier in the corpus."""
    from .run_index import remove_repeated_strings

    return remove_repeated_strings(table(spark, sf_dir, "documents"), length=100, keep_bytes=False).drop("spans")


#: CRC-32 of the decimal number in ``doc_id``: eight steps a byte, as bits.
CRC_SQL = """xor(4294967295, list_reduce(
  list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE marked AS (
  SELECT *, coalesce({CRC_SQL} % 7 = 0, false) AS hit FROM documents
),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + hit::int)")} AS claimed FROM marked
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS size
  FROM leaves
),
nodes AS (
  SELECT tree, 0 AS level, place AS i, size AS n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2
),
top AS (
  SELECT 0 AS level, tree AS i, (SELECT count(DISTINCT tree) FROM placed) AS n, digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY level, i // 2
),
-- The way of every leaf: node after node, its sibling and the digest recomputed from the claimed leaf.
way AS (
  SELECT doc_id, tree, place, leaf, claimed, true AS low, 0 AS level, place AS i, size AS n, '' AS siblings, claimed AS node FROM placed
  UNION ALL
  SELECT doc_id, tree, place, leaf, claimed, low AND n > 1, CASE WHEN low AND n > 1 THEN level + 1 WHEN low THEN 0 ELSE level + 1 END,
         CASE WHEN low AND n = 1 THEN tree ELSE i // 2 END,
         CASE WHEN low AND n = 1 THEN (SELECT count(DISTINCT tree) FROM placed) ELSE (n + 1) // 2 END,
         CASE WHEN n = 1 THEN siblings ELSE siblings || coalesce(s, '') END,
         CASE WHEN n = 1 THEN node WHEN i % 2 = 1 THEN sha256(s || node) ELSE sha256(node || coalesce(s, '')) END
  FROM (
    SELECT w.*, coalesce(a.digest, b.digest) AS s FROM way w
    LEFT JOIN nodes a ON w.low AND a.tree = w.tree AND a.level = w.level AND a.i = xor(w.i, 1)
    LEFT JOIN top b ON NOT w.low AND b.level = w.level AND b.i = xor(w.i, 1)
  )
  WHERE low OR n > 1
)
SELECT doc_id, leaf, (SELECT digest FROM nodes x WHERE x.tree = way.tree AND x.n = 1) AS subroot,
       (SELECT digest FROM top WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, node AS folded_root,
       node = (SELECT digest FROM top WHERE n = 1) AS verified
FROM way WHERE NOT low AND n = 1
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the row as it is claimed leads to the root."""
    from .merkle import folded, manifest, record_digest

    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    claimed = record_digest(["doc_id", "source", "lang", F.col("n_chars") + F.when(hit, 1).otherwise(0), "text"])
    leaf = record_digest(["doc_id", "source", "lang", "n_chars", "text"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf.alias("leaf"), F.when(hit, claimed).alias("claimed"))
    made = manifest(docs, leaf_col="leaf", group_col="lang", order_cols=["doc_id"])
    start = F.coalesce("claimed", "leaf")
    siblings = F.array_join(F.transform(F.filter("path", lambda x: x.isNotNull()), lambda x: F.lower(F.hex(x))), "")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(start, F.col("path"), F.col("index"), F.col("height"), F.col("tree")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: White space between words, as in the contract of the corpus operators.
BLANK = "[\\x20\\x09-\\x0D]+"


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, of which one in ten is made to repeat words up to its end."""
    from .periodic_runs import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", BLANK), lambda w: w != ""))
    made = docs.withColumn("words", words).withColumns({"n": F.size("words"), "g": F.expr("h div 10")})
    made = made.withColumn("a", F.expr("if(n > 0, int(g % n), 0)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    # Words a .. a + p - 1 over and over, cut at n.
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a) div p + 1))), 1, n - a)"
    made = made.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(words, 1, a), {tail}), ' '), text)").alias("text"))
    found = periodic_runs(made, min_length=12, keep_text=False)
    # The greatest length counts, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")
    )), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_html_text")
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
