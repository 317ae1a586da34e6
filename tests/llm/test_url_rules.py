import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import url_rules as ur


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de", "example.net", "/de", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("ftp://a.org/fr/x://y", "a.org", "/fr/x://y", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("a://h?q/en/", "h", "", None, "allow"),
    ("http://xnet/", "xnet", "/", None, "allow"), ("http://h\n.net/a\nb", "h\n.net", "/a\nb", "net/", "block"),
])
def test_given_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    got = ur.judge(pages, none).first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_mined_rules(spark):
    """Pages below /win/ of one host are bad; the rule for both holds and its longer forms are pruned."""
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, f"https://{'spam' if bad else 'good'}.site.com/{'win' if i % 2 == 0 else 'news'}/{i}", int(bad)))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    rules = ur.mine(ur.labelled_baskets(pages, labels))
    found = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert found[("h=spam.site.com",)] == 1.0 and all(len(t) == 1 or "h=spam.site.com" not in t for t in found)
    got = {r["page_id"]: r["verdict"] for r in ur.judge(pages, rules).collect()}
    assert all((got[i] == "block") == bool(t) for i, _, t in rows)


def test_long_rules(spark):
    """Only five tokens together are bad: pages that lack one of them are good, and as many."""
    parts = ["a", "b", "c", "d", "e"]
    urls = [("/".join(parts), 1)] * 60 + [("/".join(p for p in parts if p != gone), 0) for gone in parts for _ in range(60)]
    pages = spark.createDataFrame([(i, f"https://site.com/{u}") for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in ur.judge(pages, ur.mine(ur.labelled_baskets(pages, labels), min_confidence=0.9)).collect()}
    assert all((got[i] == "block") == bool(t) for i, (_, t) in enumerate(urls))


def test_rare_host_of_many_pages(spark):
    """A host with 30 of 30,000 pages, all bad, is a rule."""
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 1000 == 0, "https://spam.com/x").otherwise("https://good.com/x").alias("url"))
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 1000 == 0).cast("int").alias("toxic"))
    found = {tuple(r["tokens"]): r["confidence"] for r in ur.mine(ur.labelled_baskets(pages, labels)).collect()}
    assert found == {("h=spam.com",): 1.0}


def test_every_page_once(spark, data, labels):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = ur.op9_url_rules(pages, labels)
    assert got.count() == pages.count() == got.select("page_id").distinct().count()
    assert ur.op9_url_rules(pages.limit(0), labels.limit(0)).count() == 0


def test_odd_rows(spark, labels):
    pages = spark.createDataFrame([(1, None, "h"), (None, "http://a.net/x", "h"), (2, "http://a.net/x", None), (2, "http://a.net/x", None), (3, "x" * 100_000, "p")], "page_id long, url string, host string")
    rows = ur.op9_url_rules(pages, labels).collect()
    assert len(rows) == 5 and sorted(r["verdict"] for r in rows) == ["allow", "allow", "block", "block", "block"]


def test_no_python_in_the_plan(spark, data, labels):
    plan = ur.op9_url_rules(spark.read.parquet(f"{data}/pages.parquet"), labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def plain_rules(baskets, min_confidence=0.5, min_count=20, min_lift=1.2, min_z=3.0):
    """Every combination of tokens, by counting: {(tokens, verdict): (confidence, strength)}, pruned as the rules are."""
    n, bad = len(baskets), sum(b for _, b in baskets)
    held = {}
    for items, blocked in baskets:
        for size in range(1, len(items) + 1):
            for combination in itertools.combinations(sorted(items), size):
                held.setdefault(combination, [0, 0])[blocked] += 1
    rules = {}
    for tokens, both in held.items():
        for verdict, hits, share in (("allow", both[0], 1 - bad / n), ("block", both[1], bad / n)):
            total = sum(both)
            confidence = hits / total
            z = (confidence - share) * total**0.5 / max(share * (1 - share), 1e-12) ** 0.5
            if hits >= min_count and confidence >= min_confidence and confidence >= share * min_lift and z >= min_z:
                smooth = (hits + 1) / (total + 2)
                rules[tokens, verdict] = confidence, math.log(smooth / (1 - smooth)) - math.log((share * n + 1) / (n - share * n + 1))
    worse = {(t, v) for t, v in rules for u, w in rules if v == w and len(u) < len(t) and set(u) <= set(t) and rules[u, w][0] >= rules[t, v][0]}
    return {k: x for k, x in rules.items() if k not in worse}


@pytest.mark.parametrize("seed", range(3))
def test_whole_query_against_counting(spark, seed):
    """Planted hosts and folders of bad and of good pages; every page's verdict equals that of plain counting."""
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(1500):
        host, part, key = rng.choice("pqrs"), rng.choice("abc"), rng.choice(["", "?ref=1", "?id=2&ref=3"])
        pages.append((i, f"https://{host}.site{rng.choice('12')}.com/{part}/{rng.randint(0, 9)}{key}"))
        chance = 0.95 if host == "p" and part == "a" else 0.02 if host == "q" else 0.9 if "ref=3" in key and part == "c" else 0.3
        if rng.random() < 0.8:
            labels.append((i, 1, int(rng.random() < chance)))
    frame, marks = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    items = {r["page_id"]: r["items"] for r in frame.select("page_id", ur.basket(F.col("url"), ur.host_of(F.col("url")), ur.path_of(F.col("url"))).alias("items")).collect()}
    rules = plain_rules([(items[i], t) for i, _, t in labels])
    assert {v for _, v in rules} == {"allow", "block"}
    got = {r["page_id"]: r["verdict"] for r in ur.op9_url_rules(frame, marks).collect()}
    for i, _ in pages:
        fit = [(round(s, 9), len(t), v == "block", v) for (t, v), (_, s) in rules.items() if set(t) <= set(items[i])]
        assert got[i] == (max(fit)[3] if fit else "allow")


def test_long_urls_that_repeat(spark):
    """A URL of 60 parts on 40 bad pages: one item, not 2^60 combinations."""
    long = "https://x.com/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, long if i % 3 == 0 else f"https://y.com/{'ab'[i % 2]}", int(i % 3 == 0)) for i in range(120)]
    pages, labels = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in ur.op9_url_rules(pages, labels).collect()}
    assert all((got[i] == "block") == bool(t) for i, _, t in rows)
