"""Definitions nobody uses, statements nobody reaches, and slots nobody fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import scoring, text

#: Names, decorators and files that a framework or an interpreter reaches.
ENTRY_POINTS = ("main", "app", "application", "handler", "lambda_handler", "cli")
FRAMEWORK_DECORATORS = (
    "route", "get", "post", "put", "patch", "delete", "websocket", "task", "job", "command", "group", "fixture", "hookimpl", "property", "setter",
    "getter", "deleter", "cached_property", "staticmethod", "classmethod", "abstractmethod", "overload", "receiver", "signal", "event", "on", "listens_for",
    "validator", "field_validator", "model_validator", "root_validator", "setup", "teardown", "before_request", "after_request",
)
SPECIAL_FILES = ("conftest.py", "setup.py", "manage.py", "wsgi.py", "asgi.py")


def reached_by_convention(d: DataFrame) -> Column:
    """For definitions (path, name, kind, decorators, inherits, is_package_init)."""
    name, method = d["name"], d["kind"] == "method"
    dunder = name.startswith("__") & name.endswith("__")
    framework = F.arrays_overlap(d["decorators"], F.array(*[F.lit(x) for x in FRAMEWORK_DECORATORS]))
    return (
        dunder | name.isin(*ENTRY_POINTS) | name.startswith("test_") | name.startswith("Test") | d["is_package_init"] | framework
        | (method & (F.size(d["decorators"]) > 0)) | (method & d["inherits"]) | text.basename(d["path"]).isin(*SPECIAL_FILES)
    )


def confidence(d: DataFrame) -> Column:
    return F.when(F.size(d["decorators"]) > 0, "low").when((d["kind"] == "method") & ~d["is_private"], "low").when(d["is_private"], "high").otherwise("medium")


def unused(definitions: DataFrame, usage: DataFrame, own_usage: DataFrame, def_keys: list[str], name: str = "name") -> DataFrame:
    """Definitions whose name is used nowhere but in their own body.

    usage is (name, n) over everything; own_usage is (def_keys, n) of the definition's name in itself.
    """
    total = usage.groupBy(name).agg(F.sum("n").alias("used"))
    own = own_usage.groupBy(*def_keys).agg(F.sum("n").alias("own"))
    rows = definitions.join(total, name, "left").join(own, def_keys, "left")
    return rows.where(F.coalesce("used", F.lit(0)) - F.coalesce("own", F.lit(0)) <= 0).drop("used", "own")


def unused_in_scope(bindings: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """Bindings without a use in their scope."""
    return bindings.join(usage.select(*keys), keys, "left_anti")


def unreachable(statements: DataFrame, block: str, at: str, terminator: Column) -> DataFrame:
    """For each block with a terminator before its end: the statement after the first one, and how many follow."""
    by = W.partitionBy(block)
    rows = statements.withColumn("__first", F.min(F.when(terminator, F.col(at))).over(by)).withColumn("__next", F.lead(at).over(by.orderBy(at))).withColumn("__last", F.count("*").over(by)).withColumn("__n", F.row_number().over(by.orderBy(at)))
    rows = rows.where((F.col(at) == F.col("__first")) & F.col("__next").isNotNull())
    return rows.select(block, F.col(at).alias("terminator"), F.col("__next").alias("unreachable"), (F.col("__last") - F.col("__n")).alias("remaining"))


def coverage(slots: DataFrame, *keys: str, empty: float = 100.0) -> DataFrame:
    """From (keys, filled, total) per item: pooled coverage, and items that are full, partial or empty."""
    full, none = F.col("filled") == F.col("total"), F.col("filled") == 0
    measures = [
        F.count("*").alias("items"),
        F.sum("filled").alias("filled"),
        F.sum("total").alias("total"),
        F.count_if(full & (F.col("total") > 0)).alias("full"),
        F.count_if(~full & ~none).alias("partial"),
        F.count_if(none & (F.col("total") > 0)).alias("untyped"),
    ]
    rows = slots.groupBy(*keys).agg(*measures) if keys else slots.agg(*measures)
    pct = scoring.share(F.col("filled") * 100, F.col("total"), empty)
    return rows.withColumn("coverage", F.round(pct, 1)).withColumn("rating", scoring.coverage_rating(pct))


def worst_coverage(covered: DataFrame, *keys: str, least_items: int = 2, limit: int = 20) -> DataFrame:
    return covered.where(F.col("items") >= least_items).orderBy("coverage", F.desc("items"), *keys).limit(limit)


def untyped_public(functions: DataFrame, limit: int = 30) -> DataFrame:
    """Public functions (path, name, lineno, parameters, filled) with parameters and nothing annotated, most first."""
    rows = functions.where(~F.col("name").startswith("_") & (F.col("filled") == 0) & (F.col("parameters") > 0))
    return rows.select("path", F.col("label").alias("name"), "lineno", "parameters").orderBy(F.desc("parameters"), "path", "lineno").limit(limit)


def dead_totals(items: DataFrame, lines_of_code: Column) -> DataFrame:
    """One row from all dead items (category, lines, confidence): counts by category, dead lines and their share."""
    per = lambda c: F.count_if(F.col("category") == c)
    dead = F.col("category").isin("function", "class")
    lines = F.coalesce(F.sum(F.when(dead, F.col("lines"))), F.lit(0)).cast("long")
    counts = items.agg(
        per("function").alias("dead_functions"), per("class").alias("dead_classes"), per("import").alias("unused_imports"), per("local").alias("unused_locals"), per("unreachable").alias("unreachable_code"),
        F.count("*").alias("total_items"), lines.alias("dead_lines"), F.count_if(dead & (F.col("confidence") == "high")).alias("high_confidence_count"), lines_of_code.alias("loc"),
    )
    return counts.withColumn("dead_code_percentage", F.round(scoring.share(F.col("dead_lines") * 100, F.col("loc")), 2)).drop("loc")


def dead_lists(items: DataFrame, most: int = 50) -> DataFrame:
    """The items of each category that a report lists: definitions by length, all others by place, `most` of each."""
    longest = F.when(F.col("category").isin("function", "class"), -F.col("lines")).otherwise(0)
    order = W.partitionBy("category").orderBy(longest, "path", "lineno", "name")
    return items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
