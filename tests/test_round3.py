"""Work that follows the input: searches, file listings, states, tiles."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row, functions as F

from auditloom.operators import corpus, keyed
from auditloom.sources import repo_files, report_files
from auditloom.streaming import barrier
from checks import q_sources


def test_names_that_share_all_pieces(spark):
    """Numbers as names have no rare pieces; the tasks hand on little more than what is found, not names times texts."""
    rng = random.Random(3)
    numbers = [rng.randrange(10**7) for _ in range(4000)]
    names = [("r", f"pkg-{n}") for n in numbers] + [("s", f"pkg-{n}") for n in numbers[:50]] + [("r", ""), (None, "pkg-1"), ("r", "größe-ß"), ("r", "ß")]
    texts = [("r", f"pkg-{n} and pkg-{n + 1}: größe-ß") for n in numbers[:1500]] + [("s", "pkg-1"), (None, "pkg-1"), ("r", None), ("t", "x" * 3_000_000)]
    want = {(g, n) for g, n in names if g and n and any(g == h and n in (t or "") for h, t in (texts if g == "s" else texts[-4:]))}
    joined = " ".join(t for g, t in texts if g == "r" and t)
    want |= {(g, n) for g, n in names if g == "r" and n and n in joined}
    df = spark.createDataFrame(names, "_group string, _name string")
    asked = spark.createDataFrame(texts, "_group string, _text string")
    got = [tuple(r) for r in keyed.names_in_texts(df, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1500
    assert keyed.names_in_texts(df.limit(0), asked).count() == 0 and keyed.names_in_texts(df, asked.limit(0)).count() == 0


def test_many_folders_make_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repo_files, "MOST_TASKS", 8)
    for i in range(60):
        place = tmp_path / "big" / f"page={i}"
        place.mkdir(parents=True)
        (place / "f").write_text("x" * i)
    reader = repo_files.RepoFilesReader({"path": str(tmp_path)})
    shares = reader.partitions()
    assert len(shares) == 8
    found = [row for s in shares for row in reader.read(s)]
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted(("big", f"page={i}/f", i) for i in range(60))


def test_written_pages_are_listed(spark, tmp_path):
    rows = [(i, f"http://u{i}/", "é" * i) for i in range(20)] + [(25, "u", "twice"), (25, "u", "twice"), (30, "u", None), (None, "u", "gone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["folder"], r["size"]) for r in q_sources.scan_files(spark, str(tmp_path)).collect())
    names = {i: n for i, n in enumerate(q_sources.FOLDERS) if n not in ("node_modules", "dist")}
    want = [(f"{names[i % 5]}/page={i}", 2 * i + 1) for i in range(20) if i % 5 in names] + [("src/page=25", 12), ("src/page=30", 1)]
    want.append(("lib/page=__HIVE_DEFAULT_PARTITION__", 5))  # where Spark's writer put it
    assert got == sorted(want)


def test_a_late_task_leaves_no_report(spark, tmp_path):
    writer = report_files.ReportWriter(str(tmp_path))
    writer.write(iter([{"repo_id": "a/b", "report": "{}"}]))
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([{"repo_id": "c", "report": "{}"}]))
    assert list(tmp_path.iterdir()) == []


def test_reports_are_read_by_few_tasks(spark, tmp_path):
    many = spark.range(3000).select(F.concat(F.lit("r/"), "id").alias("repo_id"), "id")
    report_files.write_report_files(many, str(tmp_path))
    read = report_files.read_report_files(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 64
    assert {r["repo_id"]: r["report"] for r in read.collect()} == {f"r/{i}": f'{{"repo_id":"r/{i}","id":{i}}}' for i in range(3000)}


def test_findings_go_to_the_state_by_many(monkeypatch):
    monkeypatch.setattr(barrier, "STORED_ROWS", 4)
    calls, kept = [], []
    state = SimpleNamespace(exists=lambda: False, update=lambda v: None, get=lambda: iter(kept), appendList=lambda rows: (calls.append(len(rows)), kept.extend(rows)))
    handle = SimpleNamespace(getValueState=lambda *a: state, getListState=lambda *a: state, listTimers=lambda: [], registerTimer=lambda t: None)
    processor = barrier._barrier(("x", "y"), 1000, 1000)
    processor.init(handle)
    names = ["node", "at_ms", *barrier.FINDING_COLUMNS]
    rows = [Row(*names)("xy"[i % 2], i, *["f"] * 2, i, *["f"] * (len(names) - 5)) for i in range(10)]
    out = list(processor.handleInputRows(("a",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert calls == [4, 4, 2] and len(out) == 11 and [r["pos"] for r in out] == [None, *range(10)]


def test_slices_of_a_tile_keep_ties(spark, monkeypatch):
    monkeypatch.setattr(corpus, "QUERY_ROWS", 2)
    chunks = spark.createDataFrame([(i, "a", [1.0, float(i % 3)]) for i in range(12)], "id long, framework string, embedding array<double>")
    queries = chunks.select(F.col("id").alias("query_id"), "framework", "embedding")
    got = {}
    for r in corpus.match_chunks(queries, chunks, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: [i % 3, i % 3 + 3] for i in range(12)}
