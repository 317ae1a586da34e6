"""Complexity, Halstead counts, maintainability and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scoring


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def halstead(tokens: DataFrame, *keys: str) -> DataFrame:
    """From (keys, kind in operator/operand, token): distinct and total counts and the measures built on them."""
    operator, operand = F.col("kind") == "operator", F.col("kind") == "operand"
    counts = tokens.groupBy(*keys).agg(
        F.countDistinct(F.when(operator, F.col("token"))).alias("n1"),
        F.countDistinct(F.when(operand, F.col("token"))).alias("n2"),
        F.count_if(operator).alias("total_operators"),
        F.count_if(operand).alias("total_operands"),
    )
    made = scoring.halstead(F.col("n1"), F.col("n2"), F.col("total_operators"), F.col("total_operands"))
    return counts.select("*", *[v.alias(k) for k, v in made.items()])


def complexity_summary(functions: DataFrame, *keys: str) -> DataFrame:
    """From (keys, complexity): count, total, average, maximum and the zero-filled band histogram."""
    band = scoring.complexity_band(F.col("complexity"))
    measures = [
        F.count("complexity").alias("functions"),
        F.coalesce(F.sum("complexity"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average"),
        F.coalesce(F.max("complexity"), F.lit(0)).cast("long").alias("maximum"),
        *[F.count_if(band == b).alias(b) for b in ("low", "moderate", "high")],
    ]
    return functions.groupBy(*keys).agg(*measures) if keys else functions.agg(*measures)


def maintainability(volume: DataFrame, complexity: DataFrame, loc: DataFrame, key: str) -> DataFrame:
    """Left joins keep entities without complexity or lines; the volume is rounded before use."""
    rows = volume.select(key, F.round("volume", 2).alias("volume")).join(complexity.select(key, "complexity"), key, "left").join(loc.select(key, "loc"), key, "left")
    rows = rows.select(key, "volume", F.coalesce("complexity", F.lit(0)).alias("complexity"), F.coalesce("loc", F.lit(0)).alias("loc"))
    mi = scoring.maintainability(F.col("volume"), F.col("complexity"), F.col("loc"))
    return rows.withColumn("mi", F.round(mi, 1)).withColumn("rating", scoring.mi_rating(mi))


def lowest(rows: DataFrame, column: str, key: str, limit: int = 5) -> DataFrame:
    return rows.orderBy(column, key).limit(limit)
