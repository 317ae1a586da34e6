"""A whole analysis as named frames, its snapshot, and its rendering as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators import code, duplication, findings, history, quality, runs, trends, usage
from sparkloom.session import written
from sparkloom.sources import python_ast


def analyze(files: DataFrame, changes: DataFrame | None = None, dependencies: DataFrame | None = None, advisories: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames of one run over (path, source); one parse serves all of them. changes has a change log's roles and sha;
    a log of too few commits gives no history. Without advisories, dependencies are only counted."""
    nodes = written(python_ast.parse(files))
    loc = files.select("path", text.code_lines(F.col("source")).alias("loc"))
    functions = code.complexity(nodes)
    totals = functions.groupBy("path").agg(F.sum("complexity").alias("complexity"))
    tokens = python_ast.tokens(nodes).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "lineno"))).alias("t"))
    prints = written(duplication.token_fingerprints(tokens.select("path", F.col("t.token").alias("tokens"), F.col("t.lineno").alias("lines")), "path"))
    pairs = duplication.pairs(prints, "path")
    ranges = duplication.shared_ranges(prints, pairs, "path")
    lines = duplication.duplicated_lines(ranges, loc.withColumnRenamed("path", "doc_id"))
    issues = code.all_findings(nodes)
    dead = code.dead_items(nodes, files)
    total_loc = loc.agg(F.sum("loc")).scalar()
    hinted = code.hinted_functions(nodes)
    out = {
        "functions": functions,
        "complexity": quality.complexity_summary(functions),
        "complexity_files": code.file_complexity(nodes),
        "high_risk": code.high_risk(nodes),
        "duplicates": pairs,
        "duplication": lines.agg(F.round(scoring.share(F.sum("duplicated") * 100, F.sum("loc")), 1).alias("percent")),
        "maintainability": quality.maintainability(code.halstead(nodes), totals, loc, "path").orderBy("mi", "path"),
        "security": findings.per_file(issues),
        "severities": findings.severity_counts(issues),
        "dead_code": usage.dead_lists(dead),
        "dead_totals": usage.dead_totals(dead, total_loc),
        "type_hints": usage.worst_coverage(code.type_hints(nodes), "path"),
        "type_hint_totals": usage.coverage(hinted.select(F.col("filled"), (F.col("parameters") + 1).alias("total"))),
        "untyped_public": usage.untyped_public(hinted),
        "practices": code.practices(nodes).orderBy("path", "line", "rule"),
        "counts": code.counts(nodes).join(loc, "path"),
    }
    matches = None
    if dependencies is not None:
        matches = None if advisories is None else findings.advisory_matches(dependencies, advisories)
        out["dependencies"] = findings.dependency_summary(dependencies, matches)
        if matches is not None:
            out["advisories"] = matches
    out["security_score"] = findings.security_score(issues, total_loc, matches)
    if changes is not None and history.available(changes):
        complexity = totals.withColumnRenamed("path", "entity")
        pairs_of_files = history.coupling(changes.select(F.col("sha").alias("basket"), F.col("entity").alias("item")))
        spots, risky = history.hotspots(changes, complexity), history.knowledge_risk(changes)
        out |= {
            "hotspots": spots, "churn": history.churn(changes, "entity").orderBy(F.desc("churn"), "entity").limit(30), "coupling": pairs_of_files, "contributors": history.contributors(changes), "at_risk": risky,
            "bus_factor": history.bus_factor(history.contributions(changes.withColumn("all", F.lit(1)), "all"), "all"), "period": history.period_days(changes), "history": history.summary(spots, pairs_of_files, risky),
        }
    return out


def snapshot(report: dict[str, DataFrame]) -> DataFrame:
    """One row `metrics`: the twelve numbers of a run that are kept, 0 for what a report lacks."""
    row = health(report).select(F.col("score").cast("double").alias("health_score"), F.col("maintainability").alias("average_maintainability"), "average_complexity", F.col("duplication").alias("duplication_percentage"))
    critical = F.coalesce(F.sum(F.when(F.col("severity").isin("critical", "high"), F.col("findings"))), F.lit(0)).cast("double")
    parts = [
        report["security_score"].select(F.col("score").alias("security_score")), report["type_hint_totals"].select(F.col("coverage").alias("type_hint_coverage")), report["high_risk"].agg(F.count("*").cast("double").alias("high_risk_functions")),
        report["severities"].agg(critical.alias("critical_security_issues")), report["dead_totals"].select(F.col("total_items").cast("double").alias("dead_code_items")),
        report["counts"].agg(F.coalesce(F.sum("loc"), F.lit(0)).cast("double").alias("lines_of_code"), F.count("*").cast("double").alias("python_files")),
    ]
    parts.append(report["history"].select(F.col("critical_hotspots").cast("double")) if "history" in report else report["counts"].agg(F.lit(0.0).alias("critical_hotspots")))
    for part in parts:
        row = row.join(part)
    return row.select(F.struct(*[m[0] for m in trends.METRICS]).alias("metrics"))


def comparison(spark: SparkSession, current: DataFrame, previous_json: str | None) -> DataFrame:
    """Changes of a snapshot row against a stored one; none for a first run."""
    before = spark.createDataFrame([(previous_json,)], "j string").select(trends.snapshot(F.col("j")).alias("before")).where("before IS NOT NULL")
    each = F.explode(F.array(*[F.struct(F.lit(m[0]).alias("metric"), F.col(f"before.{m[0]}").alias("before"), F.col(f"metrics.{m[0]}").alias("after")) for m in trends.METRICS]))
    return trends.changed(before.join(current).select(each.alias("c")).select("c.*").join(trends.metric_table(spark), "metric"))


def health(report: dict[str, DataFrame]) -> DataFrame:
    """One row: score, grade and the three components."""
    mi = report["maintainability"].agg(F.coalesce(F.avg("mi"), F.lit(0.0)).alias("maintainability"))
    row = mi.join(report["complexity"].select("average")).join(report["duplication"])
    score = scoring.health(F.col("maintainability"), F.col("average"), F.col("percent"))
    return row.select(F.bround(score).cast("int").alias("score"), scoring.grade(score).alias("grade"), F.round("maintainability", 1).alias("maintainability"), F.round("average", 2).alias("average_complexity"), F.col("percent").alias("duplication"))


def table(rows: DataFrame, columns: list[str], limit: int) -> str:
    """A Markdown table of the first rows; a report's excerpt, not data."""
    got = rows.select(*columns).limit(limit).collect()
    cells = lambda values: "| " + " | ".join(str(v) for v in values) + " |"
    return "\n".join([cells(columns), cells(["---"] * len(columns)), *(cells(r) for r in got)]) if got else "None."


def _changes(changes: DataFrame) -> list[str]:
    rows = changes.where("direction <> 'unchanged'").withColumn("all", F.lit(1))
    body = runs.change_rows(rows, "all").first()
    verdict = trends.verdicts(changes.withColumn("all", F.lit(1)), "all").first()
    head = ["## Change since the previous run", f"Verdict: **{verdict['verdict']}**" if verdict else "Nothing to compare with yet."]
    return [*head, "| Metric | Before | After | Change |\n| --- | --- | --- | --- |\n" + body["rows"]] if body else head


#: Section, frame, columns and rows of a report's tables.
SECTIONS = (
    ("Complexity", "high_risk", ("path", "name", "complexity", "lineno"), 200), ("Duplicate code", "duplicates", ("doc_a", "doc_b", "similarity"), 50), ("Maintainability", "maintainability", ("path", "mi", "rating"), 5),
    ("Security", "security", ("path", "highest_severity", "issue_count"), 200), ("Vulnerable dependencies", "advisories", ("package", "version", "severity", "vulnerability_id", "fixed_versions"), 200),
    ("Dead code", "dead_code", ("category", "path", "name", "lineno", "lines", "confidence"), 250), ("Type hints", "type_hints", ("path", "coverage", "items", "untyped"), 20), ("Untyped public functions", "untyped_public", ("path", "name", "parameters"), 30),
    ("Hotspots", "hotspots", ("entity", "risk", "category", "complexity", "churn", "commits"), 25), ("Most-changed files", "churn", ("entity", "commits", "churn", "authors"), 15), ("Change coupling", "coupling", ("a", "b", "co_changes", "degree"), 30),
    ("Contributors", "contributors", ("author", "commits", "lines", "share"), 10), ("Knowledge at risk", "at_risk", ("entity", "top_author", "top_share"), 10), ("Bad practices", "practices", ("path", "line", "rule"), 500),
)


def render(name: str, report: dict[str, DataFrame], changes: DataFrame | None = None) -> str:
    """The report as Markdown: health, a summary, what changed, then a section for each family that has something."""
    top, kept = health(report).first(), snapshot(report).first()["metrics"]
    parts = [f"# {name}", f"**Health {top['score']}/100 ({top['grade']})**: maintainability {top['maintainability']}, average complexity {top['average_complexity']}, duplication {top['duplication']} %."]
    parts.append("## Summary\n\n| Metric | Value |\n| --- | --- |\n" + "\n".join(f"| {m[1]} | {kept[m[0]]:g}{m[2]} |" for m in trends.METRICS))
    if changes is not None:
        parts += _changes(changes)
    if "dependencies" in report:
        row = report["dependencies"].first()
        said = f"{row['vulnerabilities']} advisories on {row['vulnerable_package_count']} packages" if row["available"] else "advisories could not be asked"
        parts.append(f"{row['dependencies_checked']} dependencies, {row['unpinned_count']} not pinned: {said}.")
    for i, (title, key, columns, limit) in enumerate((s for s in SECTIONS if s[1] in report), 1):
        parts += [f"## {i}. {title}", table(report[key], list(columns), limit)]
    return "\n\n".join(parts) + "\n"


def comment(report: dict[str, DataFrame], changes: DataFrame, state: str, said: str) -> str:
    """A pull request's comment: the gate, what changed, the state, and all findings that block, if there are any."""
    kept = snapshot(report).first()["metrics"]
    parts = [f"**Quality gate: {'passed' if state == 'success' else 'failed'}** - {said}", *_changes(changes), "### Current state\n\n| Metric | Value |\n| --- | --- |\n" + "\n".join(f"| {m[1]} | {kept[m[0]]:g}{m[2]} |" for m in trends.METRICS)]
    blocking = report["security"].select("path", F.explode("issues").alias("i")).where(F.col("i.severity").isin("critical", "high")).select(F.col("i.severity").alias("severity"), F.col("i.rule").alias("rule"), F.concat_ws(":", "path", "i.line").alias("place"))
    found = table(blocking.orderBy(F.desc(F.col("severity") == "critical"), "place"), ["severity", "rule", "place"], 1000)
    if found != "None.":
        parts += ["### Findings that need attention", found]
    if "hotspots" in report:
        hot = table(report["hotspots"].where(F.col("category").isin("critical", "high")), ["entity", "risk", "complexity", "commits"], 5)
        parts += ["### Hotspots", hot] if hot != "None." else []
    return "\n\n".join(parts) + "\n"
