"""URL filtering by association rules, in DataFrame and SQL functions and Spark's FP-growth only.

Labelled URLs become baskets of tokens (scheme, host and its parents, path parts, query keys) with their label as one
more item. Tokens that stand in exactly the same labelled baskets are one item, so that URLs which occur again and
again, however long, add one item each to the frequent combinations and not a power of two. FP-growth mines the
combinations; rules that conclude a label, to block or to allow, stay if their support is high enough, if they are more
confident than that label's share of all baskets by a factor and by more than chance explains, and if no shorter rule
inside them is as confident. They match by an inverted index: a rule is posted under the rarest of its items, and fits
a basket that holds the others too. Of the rules that fit, the one of the highest odds against that share decides.
Given rules on host and path come first; mined rules judge what none of them fits, and the label that most baskets
have judges the rest.

Defined cases: a null URL or one without `://` has empty host and path and its basket is empty: the default judges it;
without labelled rows there are no mined rules and everything else is allowed; equal URLs get equal verdicts; pages
without an id, labels without a page and repeated labels are allowed (a page is bad if one of its labels says so);
columns of any other name are ignored, or carried as they are if `keep` names them.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCKED, ALLOWED = "label=block", "label=allow"

#: (verdict, host, path): the contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. The rules are a list of a caller's own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def basket(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens in order; digits are folded, so that numbered pages share a token."""
    fold = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    parents = F.when(
        F.size(labels) > 0,
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h="), F.array_join(F.slice(labels, i, F.size(labels)), "."))),
    ).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), fold(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), fold(F.substring_index(x, "=", 1))))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.substring_index(url, "://", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(scheme, parents, parts, keys))))


def _merged(rows: DataFrame, min_count: int) -> DataFrame:
    """(token, item): tokens of the baskets (row, items) that stand in min_count of them, with one token that stands
    for all those found in exactly the same baskets."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "row"))
    tokens = rows.select("row", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    tokens = stored(tokens.where(F.col("n") >= min_count), "tokens")
    return tokens.join(tokens.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item", "n")


def _with_items(baskets: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, items) of baskets (key, items): their tokens replaced by the items, others left out."""
    found = baskets.select(key, F.explode("items").alias("token")).join(tokens.select("token", "item"), "token")
    return found.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine(baskets: DataFrame, min_confidence: float = 0.5, min_count: int = 20, min_lift: float = 1.2, min_z: float = 3.0) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support, strength, alike) from rows of (items, blocked boolean).

    FP-growth is fitted on all baskets; a rule of any length counts if `min_count` baskets of its label hold it, if
    it is `min_lift` times as confident as the label's share, and `min_z` standard errors above it. `alike` lists, for
    each of the rule's tokens, the tokens that stand for the same item, and n the item's baskets.
    """
    schema = "rule_id long, tokens array<string>, verdict string, confidence double, support double, strength double, alike array<struct<item: string, n: long, tokens: array<string>>>"
    rows = baskets.where(F.size("items") > 0).select("items", "blocked").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "baskets")
    spark, facts = baskets.sparkSession, rows.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    n = facts["n"]
    if n < min_count:
        return spark.createDataFrame([], schema)
    tokens = small_side(_merged(rows, min_count), "tokens")
    plain = rows.select("row", "blocked").join(_with_items(rows, tokens, "row"), "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    items = stored(plain.select(F.concat("items", F.array(F.when(F.col("blocked"), F.lit(BLOCKED)).otherwise(F.lit(ALLOWED)))).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).isin(BLOCKED, ALLOWED))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.when(F.element_at("consequent", 1) == BLOCKED, "block").otherwise("allow").alias("verdict"), "confidence", "support")
    share = F.when(F.col("verdict") == "block", facts["blocked"] / n).otherwise(1 - facts["blocked"] / n)
    held = F.col("support") * n / F.col("confidence")  # baskets that hold the rule's tokens
    found = found.withColumn("share", share).withColumn("held", held)
    z = (F.col("confidence") - F.col("share")) * F.sqrt("held") / F.sqrt(F.greatest(F.col("share") * (1 - F.col("share")), F.lit(1e-12)))
    found = found.where((F.col("confidence") >= F.col("share") * min_lift) & (z >= min_z))
    smooth = (F.col("confidence") * F.col("held") + 1) / (F.col("held") + 2)
    strength = F.ln(smooth / (1 - smooth)) - F.ln((F.col("share") * n + 1) / (n - F.col("share") * n + 1))
    found = stored(found.select(F.xxhash64("verdict", "tokens").alias("rule_id"), "tokens", "verdict", "confidence", "support", strength.alias("strength")), "rules")
    # a rule goes if a shorter one of its verdict, made of some of its tokens, is as confident: met through the shorter one's rarest token
    each = found.select("rule_id", F.size("tokens").alias("size"), "verdict", "confidence", "tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    a = each.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("often", "token")).getField("token").alias("token"), F.first("size").alias("size"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("tokens").alias("tokens")).alias("a")
    b = each.alias("b")
    inside = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.verdict") == F.col("b.verdict")) & (F.col("a.size") < F.col("b.size")) & (F.col("a.confidence") >= F.col("b.confidence")))
    worse = inside.where(F.size(F.array_except("a.tokens", "b.tokens")) == 0).select(F.col("b.rule_id").alias("rule_id")).distinct()
    alike = tokens.groupBy("item").agg(F.first("n").alias("n"), F.collect_set("token").alias("same"))
    kept = found.join(worse, "rule_id", "left_anti")
    named = kept.select("rule_id", F.explode("tokens").alias("item")).join(alike, "item").groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("item", "n", F.col("same").alias("tokens")))).alias("alike"))
    return stored(kept.join(named, "rule_id").select("rule_id", "tokens", "verdict", "confidence", "support", "strength", "alike"), "rules")


def judge(pages: DataFrame, rules: DataFrame, given: tuple[tuple[str, str, str], ...] = RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns in `keep`, host, path, rule, verdict and confidence (of the mined rule that decides, else null)."""
    rows = pages.select(*keep, F.col(url_col).cast("string").alias("__url"))
    rows = rows.withColumn("__host", host_of(F.col("__url"))).withColumn("__path", path_of(F.col("__url")))
    rule, verdict = given_rule(F.col("__host"), F.col("__path"), given)
    rows = rows.withColumn("__rule", rule).withColumn("__given", verdict).withColumn("__items", basket(F.col("__url"), F.col("__host"), F.col("__path")))
    rows = rows.withColumn("__key", F.md5(F.array_join("__items", "\n")))
    out = rows
    if "alike" in rules.columns and not rules.isEmpty():
        distinct = rows.where(F.col("__given").isNull() & (F.size("__items") > 0)).groupBy("__key").agg(F.first("__items").alias("items"))
        tokens = small_side(rules.select(F.explode("alike").alias("a")).select(F.explode("a.tokens").alias("token"), F.col("a.item").alias("item")).distinct(), "tokens")
        # each rule stands under its rarest item
        rarest = F.array_min(F.transform("alike", lambda a: F.struct(a["n"], a["item"])))["item"]
        posted = small_side(rules.select(rarest.alias("item"), "tokens", F.struct("strength", F.size("tokens").alias("size"), (F.col("verdict") == "block").alias("blocks"), "verdict", "confidence").alias("by")), "posted")
        held = _with_items(distinct, tokens, "__key")
        hits = held.select("__key", "items", F.explode("items").alias("item")).join(posted, "item").where(F.size(F.array_except("tokens", "items")) == 0)
        found = hits.groupBy("__key").agg(F.max("by").alias("by")).select("__key", F.col("by.verdict").alias("__mined"), F.col("by.confidence").alias("__confidence"))
        out = rows.join(small_side(found, "judged"), "__key", "left")
    else:
        out = rows.withColumn("__mined", F.lit(None).cast("string")).withColumn("__confidence", F.lit(None).cast("double"))
    return out.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__given", "__mined", F.lit(default)).alias("verdict"), F.when(F.col("__given").isNull(), F.col("__confidence")).alias("confidence"))


def usual_verdict(baskets: DataFrame) -> str:
    """The label that most baskets have; allow if as many have either, or none."""
    got = baskets.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    return "block" if 2 * got["blocked"] > got["n"] else "allow"


def labelled_baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, items, blocked) of the pages whose page_id is a labelled doc_id: blocked if toxic or of bad quality."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    rows = pages.select(F.col("page_id").alias("key"), F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return rows.join(marks, F.col("key") == F.col("doc_id")).select("key", basket(F.col("url"), host, path).alias("items"), "blocked")


def op9_url_rules(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of every page."""
    baskets = stored(labelled_baskets(pages, labels), "labelled")
    return judge(pages, mine(baskets), default=usual_verdict(baskets))
