import random
import re

import numpy as np
import pyarrow as pa
import pytest
from comparison import duck_rows, spark_rows

from sparkloom.llm import ngram_join as nj
from sparkloom.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, len(sets[i]), low.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed):
    """Random texts, near copies of some, a passage that many share, short texts, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))]
        texts.append(base)
        for _ in range(rng.choice([0, 1, 6, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(rng.randint(1, 12))] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*rows, (900, rows[0][1].upper()), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, " \t"), (None, rows[1][1]), (None, "alone word here now so it is"), (904, "\u00c9t\u00e9 \u00e9t\u00e9"), (905, "\u00e9t\u00e9 \u00e9t\u00e9")]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 1 << 19), (2, 1 << 19), (3, 0)])
def test_equal_to_brute_force(spark, seed, frequent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.join(df, most_frequent=frequent).collect()), key=str)
    assert got == plain(rows)


def test_equal_to_sql(docs, data):
    assert spark_rows(nj.op8_ngram_join(docs)) == duck_rows(data, nj.OP8_SQL)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.op8_ngram_join(odd_docs).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert nj.op8_ngram_join(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_similar_sets_share_a_key(seed):
    """The prefix's claim, over random classes of tokens."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        n = int(rng.choice([2, 3, 5, 9, 16, 40, 130, 400]))
        universe = rng.integers(0, 2**63, 2 * n + 4).astype(np.uint64)
        universe.sort()
        share = rng.choice([0, 0.3, 0.8, 1.0])
        df = dict(zip(universe.tolist(), np.where(rng.random(len(universe)) < share, rng.integers(1, 4, len(universe)), 0).tolist(), strict=True))
        x = rng.choice(universe, n, replace=False)
        lost, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        rest = np.setdiff1d(universe, x)
        y = np.concatenate([rng.permutation(x)[lost:], rng.permutation(rest)[:new]])
        both = len(np.intersect1d(x, y))
        if both * 100 < 75 * (len(x) + len(y) - both) or set(x) == set(y):
            continue
        keys = [set(nj.prefix_keys(np.sort(s), np.array([df[t] for t in np.sort(s).tolist()]), 75).tolist()) for s in (x, y)]
        assert keys[0] & keys[1]


def test_shingles_over_slices():
    texts = ["a b c d e f", None, "A  b\tC d e F", "x", "", "one two three"]
    sets = nj.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 0, 2, 1, 0, 1] and list(sets[0]) == list(sets[2])


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda i: i if parent.setdefault(i, i) == i else find(parent[i])
    import sys

    sys.setrecursionlimit(10_000)
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
