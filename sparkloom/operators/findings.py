"""Findings: secrets in text, severities, dependencies and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text

ASSIGNMENT = r"(?i)([a-z_][a-z0-9_]*) = \"([^\"\n]*)\""


def assignments(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line, name, value) of `name = "value"` in each line."""
    lines = docs.where(F.contains(F.col(column), F.lit('= "'))).select(key, F.posexplode(F.split(column, "\n")).alias("at", "source"))
    hits = lines.select(key, (F.col("at") + 1).alias("line"), F.explode(F.arrays_zip(F.regexp_extract_all("source", F.lit(ASSIGNMENT), F.lit(1)).alias("name"), F.regexp_extract_all("source", F.lit(ASSIGNMENT), F.lit(2)).alias("value"))).alias("hit"))
    return hits.select(key, "line", F.col("hit.name").alias("name"), F.col("hit.value").alias("value"))


def secret_assignments(found: DataFrame) -> DataFrame:
    return found.where(text.is_secret_assignment(F.col("name"), F.col("value"))).withColumn("match", text.redact(F.col("value")))


def entropy_findings(tokens: DataFrame, column: str = "token", least_length: int = 20, least_bits: float = 4.0) -> DataFrame:
    key_like = (F.length(column) >= least_length) & F.rlike(F.col(column), F.lit(text.KEY_LIKE)) & ~text.is_placeholder(F.col(column))
    return tokens.where(key_like).withColumn("bits", text.entropy(F.col(column))).where(F.col("bits") >= least_bits)


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which has to be unique within a key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per path, line and first 16 characters; named assignments (pass 1) win over formats (pass 2)."""
    return first_wins(findings, [F.col("path"), F.col("line"), F.left("value", F.lit(16))], [F.col("pass"), F.col("at")])


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """One row per key and rung of the ladder, zero-filled, with the penalty that the rung's findings add."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in scoring.SEVERITIES]
    wide = findings.groupBy(*keys).agg(*counts) if keys else findings.agg(*counts)
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in scoring.SEVERITIES])).alias("r"))
    long = long.select(*keys, "r.severity", "r.findings")
    return long.withColumn("penalty", F.col("findings") * scoring.penalty(F.col("severity")))


def per_file(findings: DataFrame) -> DataFrame:
    """Findings of each file, worst first, with their number and the worst severity."""
    rank = scoring.severity_rank(F.col("severity"))
    rows = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "line", "rule", "severity"))).alias("issues"))
    out = rows.select("path", "issues", F.size("issues").alias("issue_count"), F.element_at("issues", 1)["severity"].alias("highest_severity"), text.is_test_path(F.col("path")).alias("is_test"))
    return out.orderBy("is_test", F.element_at("issues", 1)["rank"], F.desc("issue_count"), "path")


def worst_per_package(advisories: DataFrame) -> DataFrame:
    rank = F.min(scoring.severity_rank(F.col("severity")))
    return advisories.groupBy("package").agg(rank.alias("rank"), F.count("*").alias("advisories")).withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in scoring.SEVERITIES]), F.col("rank")))


def security_score(code: DataFrame, loc: Column, dependencies: DataFrame | None = None) -> DataFrame:
    """One row: the score from findings per line and from each vulnerable package's worst advisory."""
    total = code.agg(F.coalesce(F.sum(scoring.penalty(F.col("severity"))), F.lit(0.0)).alias("code"))
    worst = F.lit(0.0)
    if dependencies is not None:
        worst = worst_per_package(dependencies).agg(F.coalesce(F.sum(scoring.penalty(F.col("severity"))), F.lit(0.0))).scalar()
    return total.select(F.round(scoring.security_score(F.col("code"), loc, worst), 1).alias("score"))


def requirements(lines: DataFrame) -> DataFrame:
    """From (source, line_no, line): package, version, pinned, operator, source. Comments and markers go; the first
    mention of a name and version wins."""
    bare = F.trim(F.substring_index(F.substring_index("line", "#", 1), ";", 1))
    part = lambda i: F.regexp_extract(bare, text.REQUIREMENT, i)
    rows = lines.select("source", "line_no", F.lower(part(1)).alias("package"), part(2).alias("operator"), part(3).alias("version")).where("package <> ''")
    rows = first_wins(rows, [F.col("package"), F.col("version")], [F.col("source"), F.col("line_no")])
    return rows.withColumn("pinned", F.col("operator") == "==").orderBy("source", "line_no")


def advisory_matches(dependencies: DataFrame, advisories: DataFrame, most: int = 200) -> DataFrame:
    """Dependencies joined with the advisories on their version; up to three fixed versions, in text order. A lookup
    asks for the first `most` dependencies, in order of mention. A record without details says so."""
    fixes = F.slice(F.array_sort(F.array_distinct("fixed_versions")), 1, 3)
    dependencies = dependencies.orderBy("source", "line_no").limit(most)
    if "summary" in advisories.columns:
        advisories = advisories.withColumn("summary", F.trim(F.left(F.coalesce("summary", F.lit("Advisory details unavailable.")), F.lit(300))))
    out = dependencies.join(advisories.withColumn("fixed_versions", fixes), ["package", "version"])
    return out.orderBy(scoring.severity_rank(F.col("severity")), "package", "vulnerability_id")


def advisory_severity(word: Column, scores: Column, affected_words: Column) -> Column:
    """A record's severity: its own word, else what its CVSS vectors say, else an affected package's word, else medium."""
    known = F.create_map(*[F.lit(x) for pair in (("CRITICAL", "critical"), ("HIGH", "high"), ("MODERATE", "medium"), ("MEDIUM", "medium"), ("LOW", "low")) for x in pair])
    critical = F.exists(scores, lambda s: s.contains("AV:N") & s.contains("C:H"))
    high = F.exists(scores, lambda s: s.contains("C:H") | s.contains("I:H"))
    named = F.filter(F.transform(affected_words, lambda w: known[F.upper(w)]), lambda w: w.isNotNull())
    return F.coalesce(known[F.upper(word)], F.when(critical, "critical"), F.when(high, "high"), F.try_element_at(named, F.lit(1)), F.lit("medium"))


def dependency_summary(dependencies: DataFrame, matches: DataFrame | None) -> DataFrame:
    """One row: whether the advisories could be asked, dependencies, unpinned ones, advisories, vulnerable packages."""
    row = dependencies.agg(F.count("*").alias("dependencies_checked"), F.count_if(~F.col("pinned")).alias("unpinned_count"))
    if matches is None:
        return row.select(F.lit(False).alias("available"), "*", F.lit(0).cast("long").alias("vulnerabilities"), F.lit(0).cast("long").alias("vulnerable_package_count"))
    found = matches.agg(F.count("*").alias("vulnerabilities"), F.countDistinct("package").alias("vulnerable_package_count"))
    return row.withColumn("available", F.lit(True)).join(found).select("available", "dependencies_checked", "unpinned_count", "vulnerabilities", "vulnerable_package_count")


def severity_shares(counts: DataFrame) -> DataFrame:
    """Each rung's share of all findings (severity, findings), 0 where there are none."""
    return counts.withColumn("share", scoring.share(F.col("findings"), F.sum("findings").over(W.partitionBy())))
