"""Dedup, classification, controls and scores against the fixtures and plain-Python statements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.dims import as_df, controls, privacy, rules
from auditloom.functions.severity import SEVERITY_RANK
from auditloom.operators import mapping, merge, scoring
from auditloom.plans import audit

RULE_CASES = [
    ("github_mfa", 2, {"CC6.1", "A.9.4.1"}),
    ("python.lang.security.audit.hardcoded-password", 4, {"CC6.1"}),
    ("python.lang.security.audit.sqli", 4, {"CC6.6"}),
    ("python.lang.security.audit.exec", 2, {"CC6.6"}),
    ("some.random.secret.finding", 4, set()),
    ("audit.detected.sqli.injection", 4, {"CC6.6"}),
    ("audit.detected.weak-crypto", 4, {"CC6.7"}),
    ("completely.unknown.rule", 2, {"CC7.1"}),
    ("", 2, set()),
]


def test_dimension_sizes():
    assert len(controls.finding_types()) == 69 and len(controls.control_rows()) == 194
    assert len(rules.rule_rows()) == 129 and len(privacy.CURATED) == 11


def test_rule_to_controls(findings):
    rows = [{"rule_id": rule, "title": rule, "repo_id": str(i)} for i, (rule, _, _) in enumerate(RULE_CASES)]
    mapped = mapping.map_controls(mapping.classify(findings(*rows))).collect()
    for i, (_, n, ids) in enumerate(RULE_CASES):
        mine = [r for r in mapped if r["repo_id"] == str(i)]
        assert len(mine) == n
        assert ids <= {r["control_id"] for r in mine}


def test_last_iso_control_and_first_privacy_control(findings):
    typed = mapping.classify(findings({"rule_id": "cicd_missing_sast_gate"}, {"rule_id": "dc_sensitive_x", "title": "t"}))
    got = {(r["rule_id"], r["framework"]): (r["control_id"], r["control_name"]) for r in mapping.mapped_controls(typed).collect()}
    assert got[("cicd_missing_sast_gate", "iso27001")][0] == "A.8.28"
    assert got[("dc_sensitive_x", "gdpr")] == ("gdpr_article_9", "")
    assert ("cicd_missing_sast_gate", "gdpr") not in got


def plain_type(rule_id, description, preset):
    if preset:
        return preset
    rid, desc = (rule_id or "").lower().strip(), (description or "").lower()
    for _, kind_of, kind, needle, words in rules.rule_rows():
        hit = {"exact": rid == needle, "prefix": rid.startswith(needle), "contains": needle in rid}[kind]
        if hit and (not words or any(w in desc for w in words)):
            return kind_of
    return controls.DEFAULT_TYPE


def random_findings(n, seed):
    rng = random.Random(seed)
    needles = [row[3] for row in rules.rule_rows()]
    words = ["sql", "cookie", "docker", "plain", "mail", "a cve", "nodes", "token"]
    rows = []
    for i in range(n):
        rule = rng.choice([None, "", "X." + rng.choice(needles), rng.choice(needles).upper(), "osv_" + rng.choice(words), "github_mfa"])
        rows.append(dict(
            repo_id=f"r{rng.randrange(6)}", src_ord=rng.randrange(3), pos=i, tool=rng.choice(["semgrep", "osv", None]),
            severity=rng.choice(["critical", "high", "medium", "low", "info", "HIGH", "odd", None]),
            title=rng.choice(["T1", "T2 " + rng.choice(words), None]), description=rng.choice([None, "", "D " + rng.choice(words)]),
            rule_id=rule, finding_type=rng.choice([None, None, None, "", "xss", "own_type"]),
        ))
    return rows


def test_classify_equals_plain_rules(spark, findings):
    rows = random_findings(400, 1)
    df = findings(*rows)
    by_case = {r["pos"]: r["resolved_type"] for r in mapping.classify(df).collect()}
    by_table = {r["pos"]: r["resolved_type"] for r in mapping.classify_by_table(df, as_df(spark, "class_rules")).collect()}
    for i, row in enumerate(rows):
        want = plain_type(row["rule_id"], row["description"], row["finding_type"])
        assert by_case[i] == want and by_table[i] == want


def test_rule_id_is_stripped_of_all_white_space(findings):
    typed = mapping.classify(findings({"rule_id": " \t\nPII_email\n "}, {"rule_id": " github_mfa"}))
    assert [r["resolved_type"] for r in typed.orderBy("pos").collect()] == ["pii_in_source", "missing_authn"]


def plain_dedup(rows):
    kept = {}
    for row in sorted(rows, key=lambda r: (r["src_ord"], r["pos"])):
        key = (row["repo_id"], row["rule_id"] or f"finding_{row['src_ord']}_{row['pos']}")
        rank = SEVERITY_RANK.get(row["severity"] if row["severity"] is not None else "low", 0)
        if key not in kept:
            kept[key] = (rank, row, (row["src_ord"], row["pos"]))
        elif rank > kept[key][0]:
            kept[key] = (rank, row, kept[key][2])
    return kept


def test_dedup_equals_plain_loop(findings):
    rows = random_findings(500, 2)
    got = {(r["repo_id"], r["dedup_key"]): r for r in merge.dedup_by_rule(findings(*rows)).collect()}
    want = plain_dedup(rows)
    assert set(got) == set(want)
    for key, (_, row, place) in want.items():
        assert (got[key]["src_ord"], got[key]["pos"]) == place
        assert (got[key]["severity"], got[key]["title"], got[key]["description"]) == (row["severity"], row["title"], row["description"])


def plain_scores(mapped):
    """Scores and breakdown per repo from mapped rows in order."""
    weight = {"critical": -20, "high": -10, "medium": -3, "low": -1}
    seen, points, breakdown = set(), {}, {}
    for r in sorted(mapped, key=lambda r: (r["src_ord"], r["pos"])):
        key = (r["tool"] or "", r["rule_id"] or r["title"] or "", r["description"] or "")
        sev = (r["severity"] or "").lower()
        if ("fw", r["repo_id"], r["framework"], key) not in seen:
            seen.add(("fw", r["repo_id"], r["framework"], key))
            points[r["repo_id"], r["framework"]] = points.get((r["repo_id"], r["framework"]), 0) + weight.get(sev, 0)
        if ("all", r["repo_id"], key) not in seen:
            seen.add(("all", r["repo_id"], key))
            if sev in SEVERITY_RANK:
                breakdown[r["repo_id"], sev] = breakdown.get((r["repo_id"], sev), 0) + 1
    return points, breakdown


def test_report_equals_plain_scores(spark, findings):
    df = findings(*random_findings(300, 3))
    typed = mapping.classify(mapping.preset_cve_types(merge.dedup_by_rule(df)))
    mapped = mapping.mapped_controls(typed).collect()
    points, breakdown = plain_scores(mapped)
    repos = spark.createDataFrame([(f"r{i}", None) for i in range(6)] + [("empty", None), ("bad", "no")], "repo_id string, error string")
    for r in audit.audit_report(df, repos).collect():
        if r["repo_id"] == "bad":
            assert r["overall_score"] == 0 and r["score_soc2"] == 0 and r["controls_soc2"] == 0 and r["error"] == "no"
            continue
        scores = [max(0, 100 + points.get((r["repo_id"], fw), 0)) for fw in controls.FRAMEWORKS]
        assert [r[f"score_{fw}"] for fw in controls.FRAMEWORKS] == scores
        assert r["overall_score"] == round(0.35 * scores[0] + 0.25 * scores[1] + 0.25 * scores[2] + 0.15 * scores[3])
        for sev in SEVERITY_RANK:
            assert r[sev] == breakdown.get((r["repo_id"], sev), 0)
        for fw in controls.FRAMEWORKS:
            mine = [m for m in mapped if m["repo_id"] == r["repo_id"] and m["framework"] == fw]
            assert r[f"findings_{fw}"] == len(mine)
            assert r[f"controls_{fw}"] == len({m["control_id"] for m in mine})


def mapped_frame(findings, *rows):
    base = findings(*[{k: v for k, v in row.items() if k != "framework"} for row in rows])
    frame = base.withColumn("framework", F.element_at(F.array(*[F.lit(r.get("framework", "soc2")) for r in rows]), F.col("pos").cast("int") + 1))
    return frame.withColumn("control_id", F.lit("CC6.1"))


def test_score_cases(spark, findings):
    repos = spark.createDataFrame([("r",)], "repo_id string")

    def scores(*rows):
        return {r["framework"]: r["score"] for r in scoring.framework_scores(mapped_frame(findings, *rows), repos).collect()}

    one = scores({"rule_id": "1", "severity": "critical"})
    assert one["soc2"] == 80 and one["iso27001"] == 100
    three = scores(*[{"rule_id": s, "severity": s} for s in ("critical", "high", "medium")])
    assert three["soc2"] == 67
    twice = mapped_frame(findings, {"severity": "high"}, {"severity": "high", "framework": "iso27001"})
    assert scoring.severity_breakdown(twice).first()["high"] == 1


@pytest.mark.parametrize("soc2, rest, want", [(100, 100, 100), (0, 0, 0), (50, 100, 82)])
def test_overall_score(spark, soc2, rest, want):
    rows = [("r", fw, soc2 if fw == "soc2" else rest) for fw in controls.FRAMEWORKS]
    df = spark.createDataFrame(rows, "repo_id string, framework string, score int")
    assert scoring.overall_score(df).first()["overall_score"] == want


def test_excluded_types_have_no_privacy_rows(findings):
    rows = [{"rule_id": f"x{i}", "finding_type": t} for i, t in enumerate(controls.PRIVACY_EXCLUDED_TYPES)]
    mapped = mapping.mapped_controls(mapping.classify(findings(*rows)))
    assert mapped.where("framework in ('gdpr', 'dpdp')").count() == 0


def test_remediation_keeps_own_text(findings):
    typed = mapping.classify(findings({"rule_id": "a.xss", "remediation": "own"}, {"rule_id": "b.ssrf"}, {"rule_id": "sql-format"}))
    got = {r["rule_id"]: r["remediation"] for r in mapping.add_remediation(typed).collect()}
    assert got["a.xss"] == "own" and got["b.ssrf"].startswith("Restrict outbound") and got["sql-format"] is None


def test_explain_falls_back_per_item(findings):
    mapped = mapping.mapped_controls(mapping.classify(findings({"rule_id": "a.xss"}, {"rule_id": "bad.xss"})))

    def writer(items):
        if any(i["title"] == "bad.xss" for i in items):
            raise RuntimeError("no answer")
        return ["written"] * len(items)

    got = {(r["rule_id"], r["framework"]): r["explanation"] for r in mapping.explain(mapped, writer).collect()}
    assert got[("a.xss", "soc2")] == "written" and got[("bad.xss", "soc2")].startswith("Finding 'bad.xss'")


def test_flagship_plan_has_no_pairs_and_no_python(spark):
    from checks.q_audit import all_findings, all_repos

    sf = "/root/testdata/sf0.001"
    plan = audit.audit_report(all_findings(spark, sf), all_repos(spark, sf))._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas", "SinglePartition"):
        assert word not in plan
