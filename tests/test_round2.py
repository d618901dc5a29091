"""Positions, places, repeated models, hidden files, vectors without direction, long tokens."""

import pytest
from pyspark.sql import functions as F

from auditloom import session
from auditloom.operators import content, corpus, data_fields, governance, merge, packages, scoring, workflows, mapping
from auditloom.plans import audit
from auditloom.sources import files as sf_files

FIELD = "repo_id string, source_file string, model string, model_pos int, field_pos int, name string, field_type string, line_number int, comment string"
STEP = "repo_id string, file_path string, wf_name string, job string, step_no bigint, run string, uses string, env map<string,string>"
SETTINGS = (
    "repo_id string, owner string, repo string, source_type string, private boolean, default_branch string, policy_url string, "
    "legacy_status int, required_reviews boolean, rules_status int, n_rules int, org_2fa boolean, signatures_enabled boolean"
)


def _scanned(spark):
    steps = spark.createDataFrame([
        ("r", ".github/workflows/b.yml", "b", "j", 0, "npm publish", "", {"KEY": "x" * 30}),
        ("r", ".github/workflows/a.yml", "a", "j", 1, "echo ghp_1", "", {"KEY": "y" * 30}),
    ], STEP)
    settings = spark.createDataFrame([("r", "o", "n", "github", False, "main", None, 404, None, 404, 0, False, False)], SETTINGS)
    repos = spark.createDataFrame([("r", "o", "github")], "repo_id string, owner string, source_type string")
    fields = spark.createDataFrame([("r", "s", "User", 0, 0, "ssn", "String", 1, "")], FIELD)
    files = spark.createDataFrame([], "repo_id string, path string")
    hosted = governance.settings_findings(settings)
    return merge.merge_findings(
        cicd=workflows.workflow_findings(steps.select("repo_id", "file_path"), steps),
        github=hosted.where("tool = 'github'"), governance=governance.missing_governance(repos, files),
        data_class=data_fields.model_pii(fields),
    )


def test_scanner_findings_are_scored(spark):
    found = _scanned(spark)
    assert found.where("pos IS NULL OR src_ord IS NULL").isEmpty()
    report = audit.audit_report(found).first()
    mapped = mapping.mapped_controls(audit.prepare_findings(found))
    scores = {r["framework"]: r["score"] for r in scoring.framework_scores(mapped, found.select("repo_id").distinct()).collect()}
    assert {fw: report[f"score_{fw}"] for fw in scores} == scores
    assert report["total_findings"] > 5 and report["overall_score"] < 100


def test_positions_follow_file_and_step(spark):
    found = _scanned(spark).where("tool = 'cicd'").orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(len(found)))
    assert found[0]["file_path"].endswith("a.yml")


def test_tables_without_positions_are_refused(spark):
    with pytest.raises(ValueError, match="pos"):
        merge.as_findings(spark.createDataFrame([("r", "t", "low", "x", "d", "id")], "repo_id string, tool string, severity string, title string, description string, rule_id string"), "cicd")


@pytest.mark.parametrize("pos", [5, 2**57 + 5, 2**62])
def test_huge_positions_keep_their_source(findings, pos):
    rows = findings(dict(src_ord=0, pos=pos, severity="low", rule_id="a", title="t", description="d"), dict(src_ord=1, pos=1, severity="critical", rule_id="b", title="t", description="d"))
    report = audit.audit_report(rows).first()
    assert report["total_findings"] == report["critical"] + report["low"]
    keyed = {s: report[s] for s in ("critical", "low")}
    assert keyed in ({"critical": 1, "low": 1}, {"critical": 0, "low": 1})


def test_findings_without_id_and_position_stay_apart(findings):
    rows = findings(dict(rule_id=None, pos=None, title="one"), dict(rule_id=None, pos=None, title="two"), dict(rule_id="", pos=None, title="two"))
    assert merge.dedup_by_rule(rows).count() == 3


def test_first_of_repeated_models_counts(spark):
    rows = [("r", "f", "A", 0, 0, "email", "String", 0, ""), ("r", "f", "A", 1, 0, "ssn", "Encrypted", 0, "")]
    got = data_fields.model_pii(spark.createDataFrame(rows, FIELD)).collect()
    assert [(r["rule_id"], "(email)" in r["description"]) for r in got] == [("dc_unencrypted_a", True)]
    own = data_fields.model_pii(spark.createDataFrame([("r", "f", "B", 0, 0, "badge_no", "String", 0, "")], FIELD), direct=("badge_no",)).collect()
    assert own[0]["rule_id"] == "dc_unencrypted_b"


def test_hidden_files_and_folders_of_the_same_name(spark, tmp_path):
    top = tmp_path / "repos" / "old" / "repos"
    names = ("a.py", "__init__.py", "_models/models.py", ".env", "src/.hidden.sql", ".github/workflows/ci.yml", "node_modules/x.py", "sub/.git/c")
    for name in names:
        (top / "one" / name).parent.mkdir(parents=True, exist_ok=True)
        (top / "one" / name).write_text(name)
    got = {(r["repo_id"], r["path"], r["content"]) for r in sf_files.scan_files(spark, str(top)).collect()}
    assert got == {("one", n, n) for n in names[:6]}
    assert sf_files.scan_files(spark, str(top), with_content=False).columns == ["repo_id", "path", "size"]


def test_vectors_without_direction(spark):
    chunks = spark.createDataFrame([(1, "a", [0.0, 0.0], "x"), (2, "a", [1.0, 0.0], "y"), (3, "a", None, "z"), (4, "a", [1.0, None], "n"), (5, "b", [1.0, 0.0], "w")], "id long, framework string, embedding array<double>, content string")
    queries = spark.createDataFrame([("p", "a", [2.0, 0.0]), ("q", "a", [0.0, 0.0]), ("n", "a", None)], "query_id string, framework string, embedding array<double>")
    got = corpus.match_chunks(queries, chunks, 3).select("query_id", "id", "similarity", "content").collect()
    assert [tuple(r) for r in got] == [("p", 2, 1.0, "y")]


def test_long_tokens(spark):
    texts = ["eyJ" + "a" * 1500 + ".eyJ", 'token = "' + "b" * 600 + '"', "AKIA" + "A" * 40, "x" * 100 + "@" + "y" * 300 + ".org"]
    docs = spark.createDataFrame([("r", i, f"f{i}", t) for i, t in enumerate(texts)], "repo_id string, pos long, path string, text string")
    got = {r["rule_id"] for r in content.content_findings(content.content_scan(docs)).collect()}
    assert {"gitleaks_jwt", "pii_credential", "gitleaks_aws-token", "pii_email"} <= got


def test_substring_match(spark):
    parts = spark.createDataFrame([("r", n, i, "1", "npm") for i, n in enumerate(("express", "ab", "leftpad", "Express-Session", "exprezz"))], "repo_id string, name string, pos long, version string, ecosystem string")
    stale = parts.select("repo_id", F.col("name").alias("package"), F.lit(True).alias("is_stale"), F.lit("2020-01-01").alias("last_release"))
    told = spark.createDataFrame([("r", "x", "express-session: 2 known", "about a tab"), ("s", "y", "leftpad", "leftpad")], "repo_id string, package string, title string, description string")
    got = {r["name"] for r in packages.stale_with_cve(parts, stale, told, match="substring").collect()}
    assert got == {"express", "ab", "Express-Session"}


def test_shared_folder_is_needed_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_whole_files_are_searched(spark):
    from auditloom.functions import classify

    late = "x: 1\n" * 900 + "kind: Pod\napiVersion: v1\n"
    row = spark.createDataFrame([("k8s/a.yaml", late)], "p string, c string").select(
        classify.iac_framework(F.col("p"), F.col("c")).alias("whole"), classify.iac_framework(F.col("p"), F.col("c"), 2048).alias("head")
    ).first()
    assert tuple(row) == ("Kubernetes", None)


def test_new_rows_win_ties(spark):
    from auditloom.sources import store

    old = spark.createDataFrame([("k", "old", 5), ("j", "later", 9)], "key string, v string, at long")
    new = spark.createDataFrame([("k", "new", 5), ("j", "earlier", 8)], "key string, v string, at long")
    assert sorted(map(tuple, store.upsert(old, new, "key", "at").collect())) == [("j", "later", 9), ("k", "new", 5)]


def test_session_without_a_shared_folder(tmp_path):
    """A local session whose configuration names no folder can store scratch tables."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        "from auditloom.session import new_folder, remove_scratch, shared_dir\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "path = new_folder(spark, 'x')\n"
        "spark.range(3).write.parquet(path)\n"
        "assert spark.read.parquet(path).count() == 3 and shared_dir(spark) == shared_dir(spark)\n"
        "assert remove_scratch(spark) and not remove_scratch(spark)\n"
        "print('stored')\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300, cwd=root)
    assert "stored" in done.stdout, done.stderr[-2000:]
