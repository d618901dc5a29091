import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402

FINDING = "repo_id string, src_ord int, pos bigint, tool string, severity string, title string, description string, " \
          "file_path string, rule_id string, finding_type string, remediation string"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def findings(spark):
    """Builder: dicts to a findings DataFrame with the usual defaults."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            rule = row.get("rule_id", "test.rule")
            base = dict(
                repo_id="r", src_ord=0, pos=i, tool="semgrep", severity="medium", title=rule, description="A test finding",
                file_path="src/main.py", rule_id=rule, finding_type=None, remediation=None,
            )
            base.update(row)
            full.append(tuple(base[c.strip().split(" ")[0]] for c in FINDING.split(",")))
        return spark.createDataFrame(full, FINDING)

    return build
