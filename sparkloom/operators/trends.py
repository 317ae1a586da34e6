"""Metric snapshots over time: differences, verdicts, gates, and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import scoring

#: Metric, label, unit, higher_is_better, threshold, headline, and the value where a snapshot has none.
METRICS = (
    ("health_score", "Health score", "/100", True, 2.0, True, 0.0),
    ("average_maintainability", "Maintainability index", "", True, 2.0, True, 0.0),
    ("average_complexity", "Average complexity", "", False, 0.3, True, 0.0),
    ("duplication_percentage", "Duplicate code", "%", False, 1.0, True, 0.0),
    ("security_score", "Security score", "/100", True, 3.0, True, 100.0),
    ("type_hint_coverage", "Type hint coverage", "%", True, 2.0, True, 0.0),
    ("high_risk_functions", "High-risk functions", "", False, 0.5, False, 0.0),
    ("critical_security_issues", "Critical/high security issues", "", False, 0.5, False, 0.0),
    ("dead_code_items", "Dead code items", "", False, 2.5, False, 0.0),
    ("critical_hotspots", "Critical hotspots", "", False, 0.5, False, 0.0),
    ("lines_of_code", "Lines of code", "", None, 0.0, False, 0.0),
    ("python_files", "Python files", "", None, 0.0, False, 0.0),
)
#: Fixed values of the gate.
ALLOWED_CRITICAL, HEALTH_DROP = 0, 5.0


def metric_table(spark: SparkSession) -> DataFrame:
    """The metric dimension: twelve rows, so a broadcast."""
    return F.broadcast(spark.createDataFrame(METRICS, "metric string, label string, unit string, higher_is_better boolean, threshold double, headline boolean, missing double"))


def snapshot(metrics_json: Column) -> Column:
    """A struct of the twelve metrics from a JSON text; null for empty or malformed text, defaults for gaps."""
    parsed = F.try_parse_json(metrics_json)
    fields = [F.coalesce(F.try_variant_get(parsed, f"$.{m[0]}", "double"), F.lit(m[6])).alias(m[0]) for m in METRICS]
    return F.when(parsed.isNotNull(), F.struct(*fields))


def unpivoted(runs: DataFrame, *keys: str, metrics: list[str]) -> DataFrame:
    return runs.unpivot(list(keys), metrics, "metric", "value")


def differences(snapshots: DataFrame, metrics: DataFrame, run: str, *series: str) -> DataFrame:
    """Each run's metrics against the run before it in its series; pairs with a gap are left out."""
    before = F.lag("value").over(W.partitionBy(*series, "metric").orderBy(run))
    return changed(snapshots.withColumn("before", before).join(metrics, "metric"))


def changed(rows: DataFrame) -> DataFrame:
    """Rows (before, value or after, threshold, higher_is_better) with delta, percent and direction; gaps are left out."""
    rows = rows.withColumnRenamed("after", "value") if "after" in rows.columns else rows
    rows = rows.where(F.col("before").isNotNull() & F.col("value").isNotNull())
    delta = F.round(F.col("value") - F.col("before"), 2)
    percent = F.when(F.col("before") != 0, F.round(delta / F.abs("before") * 100, 1))
    rows = rows.withColumn("delta", delta).withColumn("percent", percent)
    return rows.withColumn("direction", scoring.direction(F.col("delta"), F.col("threshold"), F.col("higher_is_better")))


def verdicts(changes: DataFrame, *keys: str) -> DataFrame:
    """Any regression decides, then any improvement."""
    regressed, improved = F.count_if(F.col("direction") == "regressed"), F.count_if(F.col("direction") == "improved")
    rows = changes.groupBy(*keys).agg(regressed.alias("regressions"), improved.alias("improvements"))
    return rows.withColumn("verdict", F.when(F.col("regressions") > 0, "regressed").when(F.col("improvements") > 0, "improved").otherwise("unchanged"))


def gate(critical: Column, health_delta: Column, regressions: Column) -> Column:
    """failure for critical findings or a fall in health, else success; the note tells of smaller regressions."""
    state = F.when(critical > ALLOWED_CRITICAL, "failure").when(F.coalesce(health_delta <= -HEALTH_DROP, F.lit(False)), "failure").otherwise("success")
    note = F.when(critical > ALLOWED_CRITICAL, "critical").when(F.coalesce(health_delta <= -HEALTH_DROP, F.lit(False)), "health").when(regressions > 0, "regressions").otherwise("clean")
    return F.struct(state.alias("state"), note.alias("note"))


def latest_before(rows: DataFrame, partition: list[str], order: list[str], usable: Column, carried: str) -> DataFrame:
    """Each row with `carried` of the latest usable row before it in its partition; null if there is none."""
    frame = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(f"previous_{carried}", F.last(F.when(usable, F.col(carried)), ignorenulls=True).over(frame))


def series(rows: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """The newest `limit` rows, oldest first, numbered."""
    newest = rows.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return newest.withColumn("point", F.row_number().over(W.orderBy(*order)).cast("long")).orderBy("point")


def points(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """A series with each point's number, its change against the point before, and its height between the series'
    lowest and highest value; a flat series lies in the middle."""
    by, all_ = W.orderBy(*order), W.partitionBy()
    low, high = F.min(value).over(all_), F.max(value).over(all_)
    height = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5)
    return rows.select("*", F.row_number().over(by).cast("long").alias("point"), (F.col(value) - F.lag(value).over(by)).alias("delta"), height.alias("height"))


def headlines(changes: DataFrame, wanted: bool = True) -> DataFrame:
    """The headline changes, or all others."""
    return changes.where(F.col("headline") if wanted else ~F.col("headline"))
