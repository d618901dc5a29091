"""Extra columns with clashing names, very long texts, one id many times, empty tables: operators and pipeline stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import nearest, run_index, winnowing

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def words(rng, n):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


def test_repeated_strings_beside_clashing_columns(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    docs = table(spark, [(1, text), (2, text), (3, None), (4, "short")])
    plain = run_index.remove_repeated_strings(docs, length=100)
    names = ["anchor", "row", "spans", "id", "n_removed", "part", "context"]
    odd = run_index.remove_repeated_strings(docs.withColumns({n: F.lit("x") for n in names}), length=100)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(map(tuple, odd.select(*columns).collect()))


def test_nearest_beside_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = nearest.nearest_vectors(vectors, F.col("vec_id") % 20 == 0, k=5).collect()
    odd = vectors.withColumns({n: F.lit(-1) for n in ("id", "v", "asks", "size", "tile", "side", "q", "c", "rows", "queries")})
    assert sorted(nearest.nearest_vectors(odd, F.col("vec_id") % 20 == 0, k=5).collect()) == sorted(plain)


def test_fingerprints_of_long_texts_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(7, words(rng, 30)) for _ in range(200)] + [(7, words(rng, 60_000)), (8, None), (None, "x")]
    docs = table(spark, rows).withColumns({n: F.lit("x") for n in ("range", "guest", "id", "fingerprint", "places")})
    got = winnowing.edited_fingerprints(docs, ranges=5).collect()
    assert len(got) == len(rows) and max(r["n_chars"] for r in got) == len(rows[200][1])
    assert all(r["near_edited"] > 0 for r in got if r["n_chars"] > 1)
    assert winnowing.fingerprints(docs).count() == len(rows) and winnowing.fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    last = stage == corpus_pipeline.STAGES[-1][0]
    assert run(spark, table(spark, []), SF).count() == 0
    rng = random.Random(4)
    rows = [(i, words(rng, 40)) for i in range(30)] + [(40, None), (41, ""), (None, words(rng, 50)), (5, "one line\n" * 20)]
    plain = table(spark, rows)
    odd = plain.withColumns({n: F.lit(1) for n in ("row", "size", "class_id", "keep", "copies", "ROW_KEY", "n_removed", "score", "id", "ids")})
    made = run(spark, odd, SF)
    ids = sorted(str(r["doc_id"]) for r in run(spark, plain, SF).collect())
    assert sorted(str(r["doc_id"]) for r in made.collect()) == ids and ids
    if not last:
        assert made.columns == odd.columns
