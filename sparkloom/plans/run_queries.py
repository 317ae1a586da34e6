"""Snapshot, run, coverage and admin queries bound to orders, customers, labels and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import trends, usage
from sparkloom.plans.history_queries import table


def unused_entities(s, d):
    orders = table(s, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return usage.unused_in_scope(table(s, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def unused_per_scope(s, d):
    pairs = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    keys = ["l_partkey", "l_suppkey"]
    return usage.unused_in_scope(pairs.select(*keys).distinct(), pairs.where("l_returnflag = 'R'"), keys)


def _slots(s, d):
    marked = table(s, d, "labels").select("doc_id").distinct().withColumn("filled", F.lit(1))
    return table(s, d, "documents").select("doc_id", "source", "lang").join(marked, "doc_id", "left").select("source", "lang", F.coalesce("filled", F.lit(0)).cast("long").alias("filled"), F.lit(1).cast("long").alias("total"))


def annotation_coverage(s, d):
    out = usage.coverage(_slots(s, d), "source", "lang")
    return out.select("source", "lang", *[F.col(c).cast("long") for c in ("items", "filled", "total", "full", "partial", "untyped")], "coverage", "rating")


def worst_coverage(s, d):
    return usage.worst_coverage(usage.coverage(_slots(s, d), "source", "lang"), "source", "lang").select("source", "lang", F.col("items").cast("long"), "coverage")


def _months(s, d):
    o = table(s, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy("month").agg(
        F.round(F.avg("o_totalprice") / 3000, 2).alias("health_score"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) * 100, 2).alias("security_score"),
        F.count("*").cast("double").alias("lines_of_code"),
        F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("high_risk_functions"),
        F.countDistinct("o_custkey").cast("double").alias("python_files"),
    )


METRICS = ["health_score", "security_score", "lines_of_code", "high_risk_functions", "python_files"]


def _snapshots(s, d):
    return trends.unpivoted(_months(s, d), "month", metrics=METRICS)


def metric_snapshots(s, d):
    return _snapshots(s, d)


def _changes(s, d):
    return trends.differences(_snapshots(s, d), trends.metric_table(s), "month")


def snapshot_diff(s, d):
    return _changes(s, d).select("month", "metric", "label", "before", "value", "delta", "percent", "direction", "headline")


def trend_verdict(s, d):
    return trends.verdicts(_changes(s, d), "month").select("month", F.col("regressions").cast("long"), F.col("improvements").cast("long"), "verdict")


def quality_gate(s, d):
    rows = trends.verdicts(_changes(s, d), "month")
    health = _changes(s, d).where("metric = 'health_score'").select("month", F.col("delta").alias("health_delta"))
    critical = _months(s, d).select("month", F.floor(F.col("high_risk_functions") / 50).cast("long").alias("critical"))
    gate = trends.gate(F.col("critical"), F.col("health_delta"), F.col("regressions"))
    return rows.join(health, "month", "left").join(critical, "month").select("month", "critical", "health_delta", gate["state"].alias("state"), gate["note"].alias("note"))


def latest_run(s, d):
    o = table(s, d, "orders")
    rows = trends.latest_before(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", "o_orderkey")
    return rows.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("previous_o_orderkey").alias("previous"))


def trend_series(s, d):
    return trends.series(_months(s, d), ["month"]).select("point", "month", "health_score")


def admin_stats(s, d):
    o = table(s, d, "orders")
    c = F.col
    return o.agg(
        F.count("*").alias("runs"), F.count_if(c("o_orderstatus") == "F").alias("completed"), F.count_if(c("o_orderstatus") == "P").alias("failed"),
        F.count_if(c("o_orderpriority").startswith("1")).alias("urgent"), F.countDistinct("o_custkey").alias("users"), F.count_if(c("o_totalprice") > 200000).alias("large"),
    )


def admin_recent(s, d):
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc("o_orderkey")).limit(100).select("o_orderkey", "c_name", "o_orderstatus", F.to_date("o_orderdate").alias("day"))


def cascade_delete(s, d):
    """Orders left after the customers of one nation and all that is theirs are gone."""
    gone = table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(gone, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


_M = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice) / 3000, 2) AS health_score, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 2) AS security_score,
  count(*)::DOUBLE AS lines_of_code, (count(*) FILTER (WHERE starts_with(o_orderpriority, '1')))::DOUBLE AS high_risk_functions, count(DISTINCT o_custkey)::DOUBLE AS python_files FROM orders GROUP BY 1),
u AS (UNPIVOT m ON health_score, security_score, lines_of_code, high_risk_functions, python_files INTO NAME metric VALUE value)"""
_C = _M + """,
t(metric, label, up, threshold, headline) AS (VALUES ('health_score', 'Health score', TRUE, 2.0, TRUE), ('security_score', 'Security score', TRUE, 3.0, TRUE), ('lines_of_code', 'Lines of code', NULL, 0.0, FALSE),
  ('high_risk_functions', 'High-risk functions', FALSE, 0.5, FALSE), ('python_files', 'Python files', NULL, 0.0, FALSE)),
b AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY month) AS before FROM u),
c AS (SELECT month, metric, label, before, value, round(value - before, 2) AS delta, CASE WHEN before <> 0 THEN round(round(value - before, 2) / abs(before) * 100, 1) END AS percent,
  CASE WHEN abs(round(value - before, 2)) < threshold THEN 'unchanged' WHEN up IS NULL THEN 'changed' WHEN (round(value - before, 2) > 0) = up THEN 'improved' ELSE 'regressed' END AS direction, headline
  FROM b JOIN t USING (metric) WHERE before IS NOT NULL AND value IS NOT NULL),
v AS (SELECT month, count(*) FILTER (WHERE direction = 'regressed') AS regressions, count(*) FILTER (WHERE direction = 'improved') AS improvements FROM c GROUP BY 1)"""
_COV = """s AS (SELECT source, lang, (l.doc_id IS NOT NULL)::BIGINT AS filled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
cv AS (SELECT source, lang, count(*) AS items, sum(filled)::BIGINT AS filled, count(*) AS total, count(*) FILTER (WHERE filled = 1) AS "full", 0::BIGINT AS partial, count(*) FILTER (WHERE filled = 0) AS untyped, sum(filled) * 100.0::DOUBLE / count(*) AS raw FROM s GROUP BY 1, 2)"""

QUERIES = {
    f.__name__: f
    for f in (unused_entities, unused_per_scope, annotation_coverage, worst_coverage, metric_snapshots, snapshot_diff, trend_verdict, quality_gate, latest_run, trend_series, admin_stats, admin_recent, cascade_delete)
}
SQL = {
    "unused_entities": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')",
    "unused_per_scope": "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 0",
    "annotation_coverage": f"""WITH {_COV} SELECT source, lang, items, filled, total, "full", partial, untyped, round(raw, 1) AS coverage, CASE WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 70 THEN 'Good' WHEN raw >= 40 THEN 'Fair' ELSE 'Poor' END AS rating FROM cv""",
    "worst_coverage": f"WITH {_COV} SELECT source, lang, items, round(raw, 1) AS coverage FROM cv WHERE items >= 2 ORDER BY round(raw, 1), items DESC, source, lang LIMIT 20",
    "metric_snapshots": f"WITH {_M} SELECT * FROM u",
    "snapshot_diff": f"WITH {_C} SELECT * FROM c",
    "trend_verdict": f"WITH {_C} SELECT month, regressions, improvements, CASE WHEN regressions > 0 THEN 'regressed' WHEN improvements > 0 THEN 'improved' ELSE 'unchanged' END AS verdict FROM v",
    "quality_gate": f"""WITH {_C}, k AS (SELECT v.month, floor(high_risk_functions / 50)::BIGINT AS critical, delta AS health_delta, regressions FROM v JOIN m USING (month) LEFT JOIN c ON c.month = v.month AND metric = 'health_score')
SELECT month, critical, health_delta, CASE WHEN critical > 0 OR coalesce(health_delta <= -5, FALSE) THEN 'failure' ELSE 'success' END AS state,
  CASE WHEN critical > 0 THEN 'critical' WHEN coalesce(health_delta <= -5, FALSE) THEN 'health' WHEN regressions > 0 THEN 'regressions' ELSE 'clean' END AS note FROM k""",
    "latest_run": "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders WHERE o_orderstatus = 'F'",
    "trend_series": f"WITH {_M}, n AS (SELECT month, health_score FROM m ORDER BY month DESC LIMIT 50) SELECT row_number() OVER (ORDER BY month) AS point, month, health_score FROM n",
    "admin_stats": "SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE starts_with(o_orderpriority, '1')) AS urgent, count(DISTINCT o_custkey) AS users, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders",
    "admin_recent": "SELECT o_orderkey, c_name, o_orderstatus, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 100",
    "cascade_delete": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1",
}
