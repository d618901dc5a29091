"""Repository files as a data source and a stream, reports as files."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from auditloom.sources import files, report_files
from auditloom.streaming import progress as sp


def put(root, path, text="x", age=10):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)
    os.utime(full, (time.time() - age,) * 2)


def test_one_large_repository_is_listed_by_many_tasks(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"big/src/part{i}/deep/er/f{i}.py")
    for path in ("big/top.txt", "big/.hidden/_a", "big/node_modules/no.js", "big/src/part3/node_modules/x/no.js", "small/a.sql", "loose.txt"):
        put(tmp_path, path)
    listed = files.list_files(spark, str(tmp_path), ["node_modules"])
    got = {(r["repo_id"], r["path"]) for r in listed.collect()}
    assert got == {("big", f"src/part{i}/deep/er/f{i}.py") for i in range(30)} | {("big", "top.txt"), ("big", ".hidden/_a"), ("small", "a.sql")}
    assert listed.count() == len(got)
    parts = listed.where("repo_id = 'big'").select(F.spark_partition_id()).distinct().count()
    assert parts > 20
    # A planner that lists nothing but the repositories leaves the rest to the tasks; the rows are the same.
    few = spark.read.format("repo_files").option("skipDirs", "node_modules").option("plannedFolders", "1").load(str(tmp_path))
    assert {(r["repo_id"], r["path"]) for r in few.collect()} == got
    one = spark.read.format("repo_files").option("repos", "small,none").load("file://" + str(tmp_path))
    assert [(r["repo_id"], r["path"], r["size"]) for r in one.collect()] == [("small", "a.sql", 1)]


def test_listing_of_an_empty_root(spark, tmp_path):
    assert files.list_files(spark, str(tmp_path)).count() == 0
    assert files.scan_files(spark, str(tmp_path)).count() == 0


def test_stream_of_new_files(spark, tmp_path):
    root, out, cp = tmp_path / "repos", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = files.new_files(spark, str(root), ["dist"], settle_seconds=1)
        # A stream on the clock has no end of its input; one batch sees all that is there.
        sp.write_updates(stream, out, cp, "append", availableNow=True).awaitTermination()
        return sorted((r["batch"], r["path"]) for r in spark.read.parquet(out).collect())

    put(root, "a/one.py")
    put(root, "a/dist/no.py")
    assert [p for _, p in run()] == ["one.py"]
    first = run()
    put(root, "b/deep/two.py", age=-0.0)
    put(root, "a/one.py", "changed", age=0)
    time.sleep(2)
    got = run()
    assert sorted(p for _, p in got if (_, p) not in first) == ["deep/two.py", "one.py"]
    assert len(got) == 3


def test_report_files_are_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    reports = spark.createDataFrame([("a/b", 90), ("c", 70), ("ü ?", 1)], "repo_id string, score int")
    assert report_files.read_report_files(spark, path).count() == 0
    report_files.write_report_files(reports, path)

    def stored():
        return {r["repo_id"]: json.loads(r["report"])["score"] for r in report_files.read_report_files(spark, path).collect()}

    assert stored() == {"a/b": 90, "c": 70, "ü ?": 1}
    # A run in which a task fails leaves the reports of the one before, and no files of its own.
    broken = reports.repartition(3).withColumn("score", F.when(F.col("repo_id") == "c", F.raise_error(F.lit("no score")).cast("int")).otherwise(5))
    with pytest.raises(Exception, match="no score"):
        report_files.write_report_files(broken, path)
    assert stored() == {"a/b": 90, "c": 70, "ü ?": 1}
    assert len([p for p in os.listdir(path) if p.startswith("run-")]) == 1
    # A later run replaces all of them.
    report_files.write_report_files(reports.where("repo_id <> 'c'").withColumn("score", F.lit(3)), path)
    assert stored() == {"a/b": 3, "ü ?": 3}
    assert len(os.listdir(path)) == 2
    with pytest.raises(Exception, match="repo_id"):
        report_files.write_report_files(spark.createDataFrame([(None, 1)], "repo_id string, score int"), path)
    assert stored() == {"a/b": 3, "ü ?": 3}
