import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import findings
from sparkloom.plans import code_queries, report


@pytest.fixture(scope="module")
def frames(spark):
    twice = "def area(a, b):\n    total = 0\n    for i in range(a):\n        total += b * i\n        if total > 10:\n            total -= 1\n    return total\n"
    files = code_queries.files(spark).unionByName(spark.createDataFrame([("x.py", twice), ("y.py", twice.replace("total", "sum_").replace("area", "size"))], "path string, source string"))
    return report.analyze(files)


def test_renamed_copy_is_found(frames):
    rows = [(r["doc_a"], r["doc_b"], r["similarity"]) for r in frames["duplicates"].collect()]
    assert ("x.py", "y.py", 100.0) in rows


def test_health_and_rendering(frames):
    row = report.health(frames).first()
    assert 0 <= row["score"] <= 100 and row["grade"] in "ABCDF"
    page = report.render("sample", frames)
    assert page.startswith("# sample") and "## 4. Security" in page and "dangerous_call" in page


def test_whole_report(spark):
    """History, advisories, a comparison and a comment."""
    files = code_queries.files(spark)
    log = [(f"c{k}", path, ("Ann", "Bob")[k % 2], f"2026-01-{k + 1:02d} 10:00:00", 5 + k) for k in range(8) for path in (("app.py", "helpers.py") if k < 6 else ("app.py",))]
    changes = spark.createDataFrame(log, "sha string, entity string, author string, at string, lines int").withColumn("ts", F.col("at").cast("timestamp"))
    dependencies = findings.requirements(spark.createDataFrame([("requirements.txt", 1, "django==4.2.1"), ("requirements.txt", 2, "rich>=13.0")], "source string, line_no int, line string"))
    advisories = spark.createDataFrame([("django", "4.2.1", "A-1", "critical", ["4.2.3"], None)], "package string, version string, vulnerability_id string, severity string, fixed_versions array<string>, summary string")
    found = report.analyze(files, changes, dependencies, advisories)
    kept = report.snapshot(found)
    row = kept.first()["metrics"].asDict()
    assert row["python_files"] == 4 and row["critical_security_issues"] == 2 and row["dead_code_items"] == 6 and row["lines_of_code"] > 20
    assert found["advisories"].first()["summary"] == "Advisory details unavailable."
    before = json.dumps(row | {"health_score": row["health_score"] + 30, "dead_code_items": 0.0})
    changed = report.comparison(spark, kept, before)
    assert {r["metric"]: r["direction"] for r in changed.collect() if r["direction"] not in ("unchanged", "changed")} == {"health_score": "regressed", "dead_code_items": "regressed"}
    assert report.comparison(spark, kept, None).count() == 0
    page = report.render("sample", found, changed)
    assert all(x in page for x in ("Change since the previous run", "**regressed**", "Most-changed files", "Change coupling", "Vulnerable dependencies", "2 dependencies, 1 not pinned: 1 advisories on 1 packages", "Ann"))
    said = report.comment(found, changed, "failure", "2 critical/high security issue(s) found")
    assert said.startswith("**Quality gate: failed**") and "| critical | dangerous_eval | app.py:15 |" in said


def test_short_logs_have_no_history(spark):
    changes = spark.createDataFrame([("a", "app.py", "Ann", 1)], "sha string, entity string, author string, lines int").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    assert "hotspots" not in report.analyze(code_queries.files(spark), changes)
