"""The store of analysis runs: snapshots as JSON, listing, comparing, and who may report on a repository.

A run has run_id, user_id, repo_name, repo_url, status, health_score, commit_sha, ref, metrics_json and created_at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import findings, trends

#: The columns a store gained over time, and how long a status may be.
ADDED_COLUMNS = ("commit_sha", "ref", "metrics_json")
STATUS_LENGTH = 140


def metrics_json(metrics: Column) -> Column:
    """A snapshot struct as JSON text; null for none."""
    return F.when(metrics.isNotNull(), F.to_json(metrics))


def new_run(report: DataFrame, user_id: Column, repo_url: Column, status: str = "completed", commit_sha: Column | None = None, ref: Column | None = None) -> DataFrame:
    """A run's row from a snapshot (metrics struct, run_id, created_at); a failed run has no metrics."""
    done = status == "completed"
    none = F.lit(None).cast("string")
    return report.select(
        "run_id", user_id.alias("user_id"), text.repo_name(repo_url).alias("repo_name"), repo_url.alias("repo_url"), F.lit(status).alias("status"),
        (F.col("metrics.health_score").cast("int") if done else F.lit(None).cast("int")).alias("health_score"),
        (none if commit_sha is None else commit_sha).alias("commit_sha"), (none if ref is None else ref).alias("ref"),
        (metrics_json(F.col("metrics")) if done else none).alias("metrics_json"), "created_at",
    )


def append(run: DataFrame, path: str) -> None:
    """Add runs to the store at path. A store that can't be written raises: the caller decides whether that matters."""
    run.write.mode("append").option("mergeSchema", True).parquet(path)


def missing_columns(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(table, column) that the store lacks, of those in `wanted`, for tables that are there at all."""
    known = present.select("table").distinct()
    return wanted.join(known, "table", "left_semi").select("table", "column").subtract(present.select("table", "column"))


def listed(runs: DataFrame, user_id: int, repo_name: str | None = None, limit: int = 50) -> DataFrame:
    """A user's runs, newest first."""
    rows = runs.where(F.col("user_id") == user_id)
    if repo_name is not None:
        rows = rows.where(F.col("repo_name") == repo_name)
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def usable() -> Column:
    """Runs to compare with or to chart: completed, with a snapshot."""
    return (F.col("status") == "completed") & F.col("metrics_json").isNotNull()


def trend(runs: DataFrame, user_id: int, repo_name: str, limit: int = 50) -> DataFrame:
    """The newest usable runs of a repository, oldest first, with their metrics and short commit."""
    rows = listed(runs.where(usable()), user_id, repo_name, limit)
    rows = rows.select("run_id", "created_at", text.short_sha(F.col("commit_sha")).alias("commit_sha"), trends.snapshot(F.col("metrics_json")).alias("m"))
    return rows.where("m IS NOT NULL").select("run_id", "created_at", "commit_sha", "m.*").orderBy("created_at", "run_id")


def compared(runs: DataFrame, pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric by metric changes of pairs (user_id, base_id, head_id) of runs that the user owns: none where the head
    has no snapshot, or the base has none, which `comparison_verdict` calls a baseline."""
    own = runs.select("user_id", F.col("run_id").alias("id"), trends.snapshot(F.col("metrics_json")).alias("m"))
    side = lambda which, name: own.select("user_id", F.col("id").alias(which), F.col("m").alias(name))
    both = pairs.join(side("base_id", "before"), ["user_id", "base_id"]).join(side("head_id", "after"), ["user_id", "head_id"]).where("after IS NOT NULL")
    names = [m[0] for m in trends.METRICS]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"before.{n}").alias("before"), F.col(f"after.{n}").alias("after")) for n in names]))
    rows = both.where("before IS NOT NULL").select("user_id", "base_id", "head_id", each.alias("c")).select("user_id", "base_id", "head_id", "c.*")
    return trends.changed(rows.join(metrics, "metric"))


def comparison_verdict(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Each pair's verdict; a pair without a change row to judge by is a baseline."""
    keys = ["user_id", "base_id", "head_id"]
    return pairs.select(*keys).join(trends.verdicts(changes, *keys), keys, "left").select(*keys, F.coalesce("regressions", F.lit(0)).cast("long").alias("regressions"), F.coalesce("improvements", F.lit(0)).cast("long").alias("improvements"), F.coalesce("verdict", F.lit("baseline")).alias("verdict"))


def actors(repos: DataFrame, users: DataFrame, runs: DataFrame) -> DataFrame:
    """(repo, user_id, by): who reports on a repository `owner/name`. The owner, if their account has a token, else
    whoever analysed it last, if theirs has."""
    able = users.where(F.col("token").isNotNull())
    named = repos.select("repo", F.element_at(F.split("repo", "/"), 1).alias("login"), F.element_at(F.split("repo", "/"), -1).alias("repo_name"))
    owners = named.join(able.select("login", "user_id"), "login").select("repo", "user_id", F.lit("owner").alias("by"), F.lit(1).alias("rank"))
    last = runs.groupBy("repo_name").agg(F.max_by("user_id", F.struct("created_at", "run_id")).alias("user_id"))
    analysts = named.join(last, "repo_name").join(able.select("user_id"), "user_id").select("repo", "user_id", F.lit("analyst").alias("by"), F.lit(2).alias("rank"))
    return findings.first_wins(owners.unionByName(analysts), [F.col("repo")], [F.col("rank"), F.col("user_id")]).drop("rank")


def search(rows: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows one of whose columns holds the words, in upper or lower case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(words.lower())), F.lit(False))
    return rows.where(hit)


def status_text(state: Column, note: Column, critical: Column, before: Column, after: Column, regressions: Column) -> Column:
    """What a commit's status says, cut to the length that is shown."""
    number = lambda x: F.regexp_replace(F.round(x, 2).cast("string"), r"\.0$", "")
    said = (
        F.when(note == "critical", F.concat(critical.cast("string"), F.lit(" critical/high security issue(s) found")))
        .when(note == "health", F.concat(F.lit("Health score dropped "), number(before - after), F.lit(" points ("), number(before), F.lit(" to "), number(after), F.lit(")")))
        .when(note == "regressions", F.concat(F.lit("Passed with "), regressions.cast("string"), F.lit(" regression(s) \u2014 see the PR comment")))
        .otherwise(F.concat(F.lit("Health score "), number(after), F.lit("/100")))
    )
    return F.left(F.concat_ws(": ", F.when(state == "error", F.lit("Analysis failed")), said), F.lit(STATUS_LENGTH))


def change_rows(changes: DataFrame, *keys: str) -> DataFrame:
    """(keys, rows): the Markdown rows of a comment's table of changes, unchanged metrics left out, in the metrics' order."""
    place = F.array_position(F.array(*[F.lit(m[0]) for m in trends.METRICS]), F.col("metric"))
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    sign = F.when(F.col("delta") > 0, "+").otherwise("")
    mark = F.when(F.col("direction") == "improved", " \u2705").when(F.col("direction") == "regressed", " \u26a0\ufe0f").otherwise("")
    row = F.concat(F.lit("| "), "label", F.lit(" | "), number("before"), "unit", F.lit(" | "), number("value"), "unit", F.lit(" | "), sign, number("delta"), "unit", mark, F.lit(" |"))
    rows = changes.where(F.col("direction") != "unchanged").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), row.alias("row")))).alias("r"))
    return rows.select(*keys, F.array_join(F.transform("r", lambda x: x["row"]), "\n").alias("rows"))


def upserted(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` in the place of known rows with their keys, all other known rows as they are."""
    return known.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def previous(runs: DataFrame) -> DataFrame:
    """Each run with the metrics of the latest usable run of its user and repository before it."""
    frame = W.partitionBy("user_id", "repo_name").orderBy("created_at", "run_id").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("baseline_json", F.last(F.when(usable(), F.col("metrics_json")), ignorenulls=True).over(frame))
