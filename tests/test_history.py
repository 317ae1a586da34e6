import datetime as dt

import pytest

from sparkloom.operators import history

DAYS = {
    0: ("Alice", [("hot", 1, 0), ("calm", 1, 0)]),
    1: ("Alice", [("hot", 1, 1)]),
    2: ("Alice", [("hot", 1, 0), ("paired_a", 1, 0), ("paired_b", 1, 0)]),
    3: ("Bob", [("hot", 1, 0)]),
    4: ("Alice", [("hot", 1, 0), ("paired_a", 1, 1), ("paired_b", 1, 1)]),
    5: ("Alice", [("hot", 1, 0)]),
    6: ("Bob", [("hot", 1, 0), ("paired_a", 1, 1), ("paired_b", 1, 1)]),
}


@pytest.fixture(scope="module")
def changes(spark):
    rows = [(day, path, who, dt.datetime(2026, 1, 1 + day), float(a + b)) for day, (who, files) in DAYS.items() for path, a, b in files]
    return spark.createDataFrame(rows, "sha int, entity string, author string, ts timestamp, lines double")


def test_hotspots(spark, changes):
    complexity = spark.createDataFrame([("hot", 30), ("calm", 1), ("paired_a", 5), ("paired_b", 5)], "entity string, complexity int")
    rows = {r["entity"]: r for r in history.hotspots(changes, complexity).collect()}
    assert rows["hot"]["commits"] == 7 and rows["hot"]["raw_risk"] == pytest.approx(1.0)
    assert rows["hot"]["weighted"] == pytest.approx(7.900733, abs=1e-6)
    assert rows["paired_a"]["raw_risk"] == pytest.approx(0.136210, abs=1e-6) and rows["paired_a"]["category"] == "moderate"
    assert rows["calm"]["category"] == "low"


def test_deleted_files_are_no_hotspots(spark, changes):
    complexity = spark.createDataFrame([("hot", 30)], "entity string, complexity int")
    assert [r["entity"] for r in history.hotspots(changes, complexity).collect()] == ["hot"]


def test_contributors_and_risk(changes):
    rows = history.contributors(changes).collect()
    assert [(r["author"], r["lines"]) for r in rows] == [("Alice", 13.0), ("Bob", 6.0)]
    at_risk = history.knowledge_risk(changes).collect()
    assert [(r["entity"], r["top_share"]) for r in at_risk] == [("hot", 0.75)]


def test_coupling(changes):
    pairs = changes.selectExpr("sha AS basket", "entity AS item")
    rows = {(r["a"], r["b"]): r for r in history.coupling(pairs).collect()}
    assert set(rows) == {("hot", "paired_a"), ("hot", "paired_b"), ("paired_a", "paired_b")}
    assert rows["paired_a", "paired_b"]["jaccard"] == 1.0 and rows["hot", "paired_a"]["jaccard"] == pytest.approx(3 / 7)


def test_large_commits_say_nothing(spark):
    rows = spark.createDataFrame([(b, i) for b in range(5) for i in range(35)], "basket int, item int")
    assert history.coupling(rows).count() == 0


@pytest.mark.parametrize(("lines", "expected"), [([0], 0), ([5], 1), ([90, 10], 1), ([50, 50], 1), ([34, 33, 33], 2)])
def test_bus_factor(spark, lines, expected):
    rows = spark.createDataFrame([("x", f"a{i}", float(v)) for i, v in enumerate(lines)], "entity string, author string, lines double")
    assert history.bus_factor(rows, "entity").first()["bus_factor"] == expected


def test_decay_halves(spark):
    rows = spark.createDataFrame([("x", "a", dt.datetime(2026, 1, 1), 10.0), ("y", "a", dt.datetime(2026, 6, 30), 0.0)], "entity string, author string, ts timestamp, lines double")
    assert history.churn(rows, "entity").where("entity = 'x'").first()["weighted"] == pytest.approx(5.0)
