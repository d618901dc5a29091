"""Column functions on the fixture values."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import classify as fc, fields as ff, locations as fl, severity as fs, vectors


def values(spark, kind, inputs, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [row[1] for row in df.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_sast_severity(spark):
    given = ["error", "warning", "inventory", "info", "none", "ERROR", "Warning", ""]
    assert values(spark, "string", given, fs.sast_severity) == [
        "critical", "high", "low", "low", "medium", "critical", "high", "medium"]


def test_vuln_severity(spark):
    given = [None, "CRITICAL", "HIGH", "MEDIUM", "low", "9.5", "7.5", "5.0", "2.0", "7.5/10", "unknown",
             "CVSS:3.1/AV:N/AC:L", "NaN", "7.5d", " 9.0 ", "inf", "-inf", "1e1", ".5", ""]
    assert values(spark, "string", given, fs.vuln_severity) == [
        "medium", "critical", "high", "medium", "low", "critical", "high", "medium", "low", "high", "medium",
        "medium", "low", "medium", "critical", "critical", "low", "critical", "low", "medium"]


def test_iac_severity_and_type(spark):
    rows = [
        ("CKV_DOCKER_2", "Ensure that HEALTHCHECK instructions have been added to container images", "HIGH", "high", "iac_docker_healthcheck"),
        ("CKV_DOCKER_3", "Ensure that a user for the container has been created", None, "medium", "iac_docker_user"),
        ("CKV_S3_1", "Bucket is public", "low", "high", "iac_storage_misconfigured"),
        ("CKV_SG_1", "Open to 0.0.0.0/0", "low", "high", "iac_network_exposed"),
        ("CKV_KMS_1", "Rotation", "moderate", "medium", "iac_encryption_missing"),
        ("CKV_LOG_1", "Trail", "odd", "medium", "iac_logging_missing"),
        (None, None, "low", "low", "iac_storage_misconfigured"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cid string, name string, lev string, s string, t string")
    got = df.select("i", fs.iac_severity(F.col("lev"), F.col("name")), fc.iac_type(F.col("cid"), F.col("name")), "s", "t").orderBy("i").collect()
    for row in got:
        assert (row[1], row[2]) == (row["s"], row["t"])


@pytest.mark.parametrize("path, prefix, clean", [
    (r"C:\Users\someone\AppData\Local\Temp\tmpktjc20mn\Dockerfile", r"C:\other", "Dockerfile"),
    ("/tmp/tmpktjc20mn/src/app.py", "/tmp/other", "src/app.py"),
    ("/work/clone/src/a.py", "/work/clone/", "src/a.py"),
    (r"D:\clone\src\a.py", "D:\\clone\\", "src/a.py"),
    ("//src/a.py", None, "src/a.py"),
    (None, None, None),
])
def test_normalize_path(spark, path, prefix, clean):
    df = spark.createDataFrame([(path, prefix)], "p string, c string")
    assert df.select(fl.normalize_path(F.col("p"), F.col("c"))).first()[0] == clean


def test_repo_identity(spark):
    cases = [
        ("https://github.com/owner/repo", "owner", "repo", "github"),
        ("https://github.com/owner/repo.git", "owner", "repo", "github"),
        ("https://github.com/owner/repo/", "owner", "repo", "github"),
        ("git@github.com:owner/repo.git", "owner", "repo", "github"),
        ("git@github.com:owner/repo", "owner", "repo", "github"),
        ("https://gitlab.com/owner/repo", "owner", "repo", "gitlab"),
        ("https://gitlab.com/group/sub/project", "group", "project", "gitlab"),
        ("https://bitbucket.org/ws/repo/src/main", "ws", "repo", "bitbucket"),
        ("https://git.example.org/a/b.git", None, "b", "git"),
        ("not-a-url", None, None, "git"),
        ("", None, None, ""),
        ("zip://name", None, None, "zip"),
    ]
    got = values(spark, "string", [c[0] for c in cases], fl.repo_identity)
    assert [tuple(g) for g in got] == [c[1:] for c in cases]


def test_cache_key(spark):
    df = spark.createDataFrame(
        [("https://github.com/o/r", "abc"), ("https://github.com/o/r", ""), ("https://gitlab.com/o/r", "abc")], "u string, s string")
    keys = [row[0] for row in df.select(fl.cache_key(F.col("u"), F.col("s"))).collect()]
    assert keys[0] == "o_r_abc" and keys[1].startswith("fb_") and keys[2].startswith("fb_") and len(keys[2]) == 35


def test_field_matches(spark):
    names = ["email", "user_email", "expiryReportEmailSentAt", "EMAIL", "emails", "sensitive_", "sensitive_x", " phone "]
    assert values(spark, "string", names, ff.is_direct) == [True, True, False, True, False, False, False, True]
    assert values(spark, "string", names, ff.is_sensitive) == [False] * 5 + [True, False, False]
    assert values(spark, "string", ["user_ssn", "email"], ff.identifier_severity) == ["high", "medium"]


def test_base_package(spark):
    given = ["@img/sharp-libvips-linux-x64", "@img/sharp-libvips-darwin-arm64", "@img/sharp-libvips-linuxmusl-x64",
             "sharp-libvips-win32-ia32", "libvips-linux-riscv64", "plain-linux", "a-LINUX-X64"]
    assert values(spark, "string", given, fc.base_package) == [
        "@img/sharp-libvips", "@img/sharp-libvips", "@img/sharp-libvips", "sharp-libvips", "libvips", "plain-linux", "a"]


def test_cve_subtype(spark):
    given = ["flaw in nodemailer", "it uses a parser; denial of service", "denial of service after auth bypass", "open redirect",
             "SQL database leak", "", None, "x" * 400 + " ssrf"]
    assert values(spark, "string", given, fc.cve_subtype) == [
        "dependency_cve_email", "dependency_cve_dos", "dependency_cve_data", "dependency_cve_network",
        "dependency_cve_data", "dependency_cve_dos", "dependency_cve_dos", "dependency_cve_network"]


def test_iac_framework(spark):
    rows = [("a/main.tf", "", "Terraform"), ("x.tf.json", "", "Terraform"), ("template/s.yaml", "", "CloudFormation"),
            ("k/a.yml", "kind: Service\n", "Kubernetes"), ("k/a.yml", "x" * 3000 + "\nkind: Service\n", None),
            ("Dockerfile", "", "Dockerfile"), ("b/dockerfile", "", "Dockerfile"), ("b/Dockerfile.dev", "", "Dockerfile"), ("a.py", "", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, c string, f string")
    for row in df.select(fc.iac_framework(F.col("p"), F.col("c"), head_chars=2048).alias("g"), "f").collect():
        assert row["g"] == row["f"]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    dot, length = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a"))).first()
    assert dot == 24.0 and length == 5.0
