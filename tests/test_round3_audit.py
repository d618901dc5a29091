"""Findings are classified once, by plain substrings; reports and roll-ups keep their rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from auditloom.dims import rules
from auditloom.functions import classify, severity
from auditloom.operators import mapping, packages
from auditloom.sources import reports, store

FINDINGS = "repo_id string, tool string, severity string, title string, description string, rule_id string, finding_type string, remediation string"


def test_findings_are_classified_once(spark, tmp_path):
    """No filter in front of the joins repeats the classification, and no sort stands in front of the folders."""
    rows = [("r", "osv", "high", "t", "session", "osv_a", None, None), ("r", "secrets", "low", "t", None, " PII_phone ", "", None), ("r", "x", None, None, "d", None, "own", "do")]
    spark.createDataFrame(rows, FINDINGS).write.parquet(str(tmp_path / "in"))
    typed = mapping.add_remediation(mapping.classify(mapping.preset_cve_types(spark.read.parquet(str(tmp_path / "in")))))
    mapped = mapping.mapped_controls(typed)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "CASE" in line]
    store.write_findings(mapped, str(tmp_path / "out"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    read = spark.read.parquet(str(tmp_path / "out")).select(*mapped.columns)
    assert sorted(map(str, read.collect())) == sorted(map(str, mapped.collect())) and read.count() > 4


def test_words_of_advisories(spark):
    texts = [a + w.upper() + b for w in rules.CVE_EMAIL_WORDS + rules.CVE_DOS_WORDS + rules.CVE_DATA_WORDS + rules.CVE_NETWORK_WORDS for a in ("", "x", "a ", "\n") for b in ("", "x", ".", "\n")]
    texts += ["ses ssrf", "uses auth", "dos and xss", "form redirect", "", None]

    def pattern(words):
        return "|".join([re.escape(w) for w in words if w not in rules.CVE_WHOLE_WORDS] + [f"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)" for w in words if w in rules.CVE_WHOLE_WORDS])

    kinds = [("email", rules.CVE_EMAIL_WORDS), ("data", rules.CVE_DATA_WORDS), ("network", rules.CVE_NETWORK_WORDS)]
    want = {t: "dependency_cve_" + next((k for k, words in kinds if re.search(pattern(words), (t or "").lower())), "dos") for t in texts}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.cve_subtype(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == want
    for words in (rules.CVE_EMAIL_WORDS, rules.CVE_DOS_WORDS):
        assert classify.has_words(F.col("t"), words, rules.CVE_WHOLE_WORDS) is not None


def test_scores_of_all_forms(spark):
    scores = [None, "", "/", " /9", "9", "9.0", "8.99/10", "7", "07.0/x", " 9.5 ", "\t4\n", "+9", "-9", ".5", "5.", "1e1", "9e0/10", "nan", "-inf", "Infinity", "+inf/x", "-Infinity ",
              "info", "n", "9 9", "9a", "CVSS:3.1/AV:N", "HIGHest", "lowercase", "9/medium", "not critical", "9\n", "9\n\n", " 9", "٩", "99999999999999999999", "3.9999/10"]

    def plain(score):
        if score is None:
            return "medium"
        text = score.lower()
        for label in ("critical", "high", "medium", "low"):
            if label in text:
                return label
        head = text.split("/")[0].strip(" \t\n\x0b\f\r")
        if re.fullmatch(r"[+-]?nan|-inf(inity)?", head):
            return "low"
        if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|\+?inf(inity)?", head):
            return "medium"
        n = math.inf if "inf" in head else float(head)
        return "critical" if n >= 9 else "high" if n >= 7 else "medium" if n >= 4 else "low"

    got = spark.createDataFrame([(s,) for s in scores], "s string").select("s", severity.vuln_severity(F.col("s")).alias("k")).collect()
    assert {r["s"]: r["k"] for r in got} == {s: plain(s) for s in scores}


@pytest.mark.parametrize("emit_empty", [False, True])
def test_holes_in_dependency_reports(spark, emit_empty):
    report = ('{"results":[null,{"packages":null},{"packages":[null,{"package":{"name":"","purl":null},"vulnerabilities":[]},'
              '{"package":{"name":"a"},"vulnerabilities":[null,{"id":"1","severity":[]},{"id":"2","summary":"s","severity":[{"score":7.5}]}]}]}]}')
    got = reports.osv_vulns(spark.createDataFrame([("r", 2, report), ("r", 3, "{"), ("r", 4, None)], "repo_id string, report_no long, report string"), emit_empty).collect()
    held = [("a", "", None, None, None, "medium"), ("a", "", "1", None, None, "medium"), ("a", "", "2", "s", "7.5", "high")]
    want = [("unknown", "", None, None, None, "medium")] * (2 * emit_empty) + held
    assert [tuple(r)[2:] for r in sorted(got, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in got) == [2 * (1 << 30) + i for i in range(len(want))]


def test_rollup_keeps_order_of_positions(spark, monkeypatch):
    monkeypatch.setattr(packages, "HELD_ROWS", 4)
    rows = [(r, "p", pos, f"c{pos}", f"s{pos}", "low") for r in ("a", None) for pos in (5, None, -3, 9, 1)]
    got = packages.vuln_rollup(spark.createDataFrame(rows, "repo_id string, package string, pos long, id string, summary string, severity string").coalesce(1)).collect()
    assert [(r["pos"], r["title"]) for r in got] == [(-3, "p: 5 known vulnerabilities")] * 2
