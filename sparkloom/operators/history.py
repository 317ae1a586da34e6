"""Change history: churn, hotspots, ownership and co-change.

Changes have the columns entity, author, ts and lines; the reference time is the newest change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import scoring


def with_now(changes: DataFrame) -> DataFrame:
    """Changes with the newest ts as `now`, from a scalar subquery."""
    return changes.withColumn("now", changes.agg(F.max("ts")).scalar())


def churn(changes: DataFrame, *keys: str) -> DataFrame:
    """One row per key: commits, churn, weighted (decayed) churn, recent commits, authors, first and last change."""
    recent = F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {scoring.RECENT_DAYS} DAYS")
    return with_now(changes).groupBy(*keys).agg(
        F.count("*").alias("commits"),
        F.sum("lines").alias("churn"),
        F.sum(F.col("lines") * scoring.decay(F.col("ts"), F.col("now"))).alias("weighted"),
        F.count_if(recent).alias("recent"),
        F.countDistinct("author").alias("authors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def contributions(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys, "author").agg(F.sum("lines").alias("lines"))


def top_authors(changes: DataFrame, *keys: str) -> DataFrame:
    """Per key the author with most lines (ties to the smaller author) and their share."""
    per = contributions(changes, *keys)
    best = F.min(F.struct((-F.col("lines")).alias("minus"), F.col("author")))
    out = per.groupBy(*keys).agg(best.alias("best"), F.sum("lines").alias("total"))
    return out.select(*keys, F.col("best.author").alias("top_author"), scoring.share(-F.col("best.minus"), F.col("total")).alias("top_share"), "total")


def hotspots(changes: DataFrame, complexity: DataFrame, limit: int = 25) -> DataFrame:
    """Entities by log-normalised decayed churn times relative complexity (entity, complexity)."""
    per = churn(changes, "entity")
    per = per.withColumn("most_churn", per.agg(F.max("weighted")).scalar())
    most = complexity.agg(F.max("complexity")).scalar()
    both = per.join(complexity.withColumn("most_complexity", most), "entity").join(top_authors(changes, "entity").drop("total"), "entity")
    risk = scoring.log_norm(F.col("weighted"), F.col("most_churn")) * scoring.share(F.col("complexity"), F.col("most_complexity"))
    out = both.withColumn("raw_risk", risk).withColumn("risk", F.round(F.col("raw_risk") * 100, 1)).withColumn("category", scoring.risk_band(F.col("raw_risk")))
    return out.orderBy(F.desc("risk"), "entity").limit(limit)


def contributors(changes: DataFrame, limit: int = 15) -> DataFrame:
    per = changes.groupBy("author").agg(F.sum("lines").alias("lines"), F.count("*").alias("commits"), F.max("ts").alias("last_ts"))
    per = per.withColumn("share", scoring.share(F.col("lines"), per.agg(F.sum("lines")).scalar()))
    return per.orderBy(F.desc("lines"), "author").limit(limit)


def bus_factor(per_author: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Smallest number of authors that hold the threshold share of lines; 0 where there are no lines.

    Rows are one per key and author, so the window holds authors, not changes.
    """
    by = W.partitionBy(*keys)
    order = by.orderBy(F.desc("lines"), "author").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = per_author.select(*keys, "lines", F.row_number().over(by.orderBy(F.desc("lines"), "author")).alias("k"), F.sum("lines").over(order).alias("upto"), F.sum("lines").over(by).alias("total"))
    k = F.min(F.when((F.col("total") > 0) & (F.col("upto") >= F.col("total") * threshold), F.col("k")))
    return ranked.groupBy(*keys).agg(F.coalesce(k, F.lit(0)).cast("long").alias("bus_factor"), F.count("*").alias("authors"))


def knowledge_risk(changes: DataFrame, least_share: float = 0.75, least_commits: int = 2, limit: int = 20) -> DataFrame:
    counts = changes.groupBy("entity").agg(F.count("*").alias("commits"), F.sum("lines").alias("churn"))
    out = counts.join(top_authors(changes, "entity").drop("total"), "entity")
    return out.where((F.col("commits") >= least_commits) & (F.col("top_share") >= least_share)).orderBy(F.desc("top_share"), F.desc("churn"), "entity").limit(limit)


def coupling(baskets: DataFrame, most_items: int = 30, least_support: int = 3, least_degree: float = 0.4, limit: int = 30) -> DataFrame:
    """Items that change together (basket, item): support, degree = support / rarer item, Jaccard.

    Baskets beyond `most_items` say nothing about coupling by definition; they go before the self-join.
    """
    rows = baskets.distinct()
    alone = rows.groupBy("item").agg(F.count("*").alias("n"))
    # counted before anything is collected, so that a giant basket is never one array
    fit = rows.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size").between(2, most_items))
    usable = rows.join(fit, "basket").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = usable.select(F.posexplode("items").alias("at", "a"), "items").select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b"))
    support = pairs.groupBy("a", "b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least_support)
    na, nb = alone.select(F.col("item").alias("a"), F.col("n").alias("na")), alone.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    out = support.join(na, "a").join(nb, "b").withColumn("degree", scoring.share(F.col("co_changes"), F.least("na", "nb")))
    out = out.withColumn("jaccard", scoring.share(F.col("co_changes"), F.col("na") + F.col("nb") - F.col("co_changes")))
    return out.where(F.col("degree") >= least_degree).orderBy(F.desc("degree"), F.desc("co_changes"), "a", "b").limit(limit)


def available(changes: DataFrame, commit: str = "sha", least: int = 5) -> bool:
    """History reports need at least five commits."""
    return changes.select(commit).distinct().limit(least).count() >= least


def period_days(changes: DataFrame) -> DataFrame:
    span = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(86_400_000_000.0))
    return changes.agg(F.greatest(F.lit(1), span.cast("long")).alias("period_days"))


def summary(spots: DataFrame, pairs: DataFrame, risky: DataFrame) -> DataFrame:
    """One row: critical and high ones among the listed hotspots, listed couplings, and all files at risk."""
    counts = spots.agg(F.count_if(F.col("category") == "critical").alias("critical_hotspots"), F.count_if(F.col("category") == "high").alias("high_hotspots"))
    return counts.join(pairs.agg(F.count("*").alias("coupled_pairs"))).join(risky.agg(F.count("*").alias("knowledge_risk_files")))
