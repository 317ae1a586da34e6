"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every source gets a target of words. Complete epochs of the source come first; the rest is a weighted sample without
replacement: each document draws the exponential key -ln(u) / quality, documents are taken in order of the key, and
a prefix sum over their sizes ends the sample at the budget. The order is cut into sqrt(rows) key ranges of like numbers of rows, whose sums
are enough to decide all ranges but the one that holds the budget's end; only that range is sorted row by row, so no
source, however large, meets in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; without rows or words
nothing is taken; equal rows draw equal keys and stand side by side in the order, each counted on its own; ids are
only hashed, so null or repeated ids are allowed; columns of any name are carried by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WORDS = "[^\\x20\\x09-\\x0D]+"
#: 2^52: u is one of so many equally spaced values between 0 and 1.
STEPS = 4503599627370496.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def draw_key(id_text: Column, size: Column, quality: Column, seed: int) -> Column:
    """The Efraimidis-Spirakis key: exponential with rate `quality`, from a hash of id, size and seed."""
    digest = F.md5(F.concat_ws("|", F.coalesce(id_text, F.lit("null")), size.cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(STEPS)
    return -F.ln(u) / quality


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(__src, source_size) with target: share of all sizes by weight, none above most x its own size.

    Sources by capacity per weight: the first source that the rest, shared by weight, doesn't fill ends the full
    ones. The windows hold one row per source.
    """
    ranked = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(W.orderBy("__src")) - 1) % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(most))
    order = W.orderBy(full / F.col("__w"), "__src")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share)) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("__w").over(after)
    filled = ranked.withColumn("__level", level).withColumn("__open", F.col("__level") * F.col("__w") <= full)
    filled = filled.withColumn("__final", F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return filled.select("__src", "source_size", F.when(F.col("__final").isNull() | (F.col("__final") * F.col("__w") > full), full).otherwise(F.col("__final") * F.col("__w")).cast("double").alias("target"))


def with_ranges(sized: DataFrame, most_kinds: int = 1000) -> DataFrame:
    """sized with __range: sqrt(rows) ranges of the key, by the share of its source's keys that are smaller.

    The share is that of the mixture of exponentials that the source's qualities give, so ranges hold about as many
    rows each, whatever the qualities; with more than `most_kinds` qualities in all it is that of quality 1. It never
    falls with the key, so ranges only cut the order of the keys.
    """
    kinds = stored(sized.groupBy("__src", "__quality").agg(F.count("*").alias("n")), "kinds")
    facts = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("kinds")).first()
    n_ranges = F.lit(float(max(1, int(facts["n"] ** 0.5))))
    if facts["kinds"] > most_kinds:
        return sized.withColumn("__range", F.floor((F.lit(1.0) - F.exp(-F.col("__key"))) * n_ranges).cast("long"))
    shares = kinds.groupBy("__src").agg(F.sort_array(F.collect_list(F.struct(F.col("__quality").alias("q"), "n"))).alias("__kinds"), F.sum("n").alias("__rows"))
    below = F.aggregate("__kinds", F.lit(0.0), lambda a, k: a + k["n"] * (F.lit(1.0) - F.exp(-F.col("__key") * k["q"])))
    return sized.join(F.broadcast(shares), "__src").withColumn("__range", F.floor(below / F.col("__rows") * n_ranges).cast("long")).drop("__kinds", "__rows")


def plan_mix(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """From (__src, __size, __range): one row per source with what decides its rows."""
    ranges = sized.groupBy("__src", "__range").agg(F.sum("__size").alias("__sum"))
    ranges = stored(ranges, "mix")
    plan = targets(ranges.groupBy("__src").agg(F.sum("__sum").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("__epochs", epochs).withColumn("__rest", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    upto = F.sum("__sum").over(W.partitionBy("__src").orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow))
    run = ranges.withColumn("__upto", upto).join(plan.select("__src", "__rest"), "__src")
    # the range in which the budget ends; where it ends in none, all ranges are taken
    end = run.where(F.col("__upto") > F.col("__rest")).groupBy("__src").agg(F.min(F.struct("__range", (F.col("__upto") - F.col("__sum")).alias("__before"))).alias("__end"))
    plan = plan.join(end, "__src", "left").select("__src", "source_size", "target", "__epochs", "__rest", F.col("__end.__range").alias("__end"), F.col("__end.__before").alias("__before"))
    return stored(plan, "mix")


def mix(docs: DataFrame, size: Column, source: Column, id_text: Column, quality: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, whole: bool = False) -> DataFrame:
    """docs with __size, __source_size, __target and __taken.

    `whole` False: the one document a source's budget ends in gives only as many words as fill it. True: that
    document is taken whole if at least half of it fits, else not at all.
    """
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}  # names of our own, whatever the table's are
    sized = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], source_key(source).alias("__src"), size.alias("__size"), quality.alias("__quality"), id_text.alias("__id"))
    sized = sized.withColumn("__key", draw_key(F.col("__id"), F.col("__size"), F.col("__quality"), seed))
    sized = with_ranges(sized)
    plan = plan_mix(sized.select("__src", "__size", "__range"), weights, share, most)
    rows = sized.join(plan, "__src")
    base = F.col("__epochs") * F.col("__size")
    clear = rows.where(F.col("__end").isNull() | (F.col("__range") != F.col("__end")))
    clear = clear.withColumn("__taken", base + F.when(F.col("__end").isNull() | (F.col("__range") < F.col("__end")), F.when(F.col("__rest") > 0, F.col("__size")).otherwise(0)).otherwise(0))
    order = W.partitionBy("__src").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(order), F.lit(0))
    some = F.greatest(F.lit(0), F.least(left, F.col("__size")))
    if whole:
        some = F.when(some * 2 >= F.col("__size"), F.col("__size")).otherwise(0)
    cut = rows.where(F.col("__range") == F.col("__end")).withColumn("__taken", base + some)
    out = clear.unionByName(cut).withColumn("__taken", F.col("__taken").cast("long"))
    return out.select(*[F.col(n).alias(c) for n, c in own.items()], "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__taken")


def label_quality(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id with __q: 2 for good quality, 0.5 for bad."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__doc")).agg(F.max("quality").alias("__good")).select("__doc", F.when(F.col("__good") == 1, 2.0).when(F.col("__good") == 0, 0.5).otherwise(1.0).alias("__q"))


def op5_mixing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; unlabelled documents have quality 1."""
    slim = docs.select("doc_id", F.col("source").alias("__source"), word_count(F.col("text")).alias("__words"))
    slim = slim.join(label_quality(labels), slim.doc_id == F.col("__doc"), "left").select("doc_id", "__source", "__words", F.coalesce("__q", F.lit(1.0)).alias("__q"))
    slim = stored(slim, "sizes")
    got = mix(slim, F.col("__words"), F.col("__source"), F.col("doc_id").cast("string"), F.col("__q"))
    return got.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


#: The same rows in DuckDB: no key ranges there, one running sum per source.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), q AS (
  SELECT doc_id AS qid, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), k AS (
  SELECT d.*, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    -ln((('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR, '17')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE good WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM d LEFT JOIN q ON doc_id = qid
), s AS (
  SELECT src, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY src
), l AS (
  SELECT *, 2 * source_size AS cap,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2 * source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM s
), f AS (
  SELECT *, min(lvl) FILTER (WHERE lvl * w <= cap) OVER () AS any_open,
    first_value(CASE WHEN lvl * w <= cap THEN lvl END IGNORE NULLS) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM l
), t AS (
  SELECT src, source_size, CASE WHEN fin IS NULL OR fin * w > cap THEN cap ELSE fin * w END AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), r AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, epochs, round(target - epochs * source_size)::BIGINT
      - coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM k JOIN p USING (src)
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(room, size)))::BIGINT AS taken FROM r
"""
