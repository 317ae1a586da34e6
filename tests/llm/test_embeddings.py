import numpy as np
import pytest
from comparison import duck_rows, spark_rows
from pyspark.sql import functions as F

from sparkloom.llm import embedding_dedup as ed
from sparkloom.llm import permutation_index as pi
from sparkloom.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups of near copies, one of 150, exact copies, pairs near the threshold, and rows that take no part."""
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for size, noise in ((150, 0.02), (3, 0.03), (2, 0.05), *[(2, s) for s in np.linspace(0.03, 0.06, 30)], *[(1, 0)] * 200):
        base = rng.normal(size=64)
        for _ in range(size):
            rows.append((n, (base + noise * 8 * rng.normal(size=64)).tolist(), n % 2 if size == 1 else 1, 0.0))
            n += 1
    rows += [(n, rows[0][1], 1, 0.0), (n, rows[0][1], 1, 0.0), (n + 1, rows[0][1], 0, 0.0), (n + 2, (np.array(rows[1][1]) * 3).tolist(), 1, 0.0)]
    rows += [(n + 3, None, 1, 0.0), (n + 4, [0.0] * 64, 1, 0.0), (n + 5, [float("nan")] * 64, 1, 0.0), (n + 6, [1.0, None] * 32, 1, 0.0), (n + 7, [float("inf")] * 64, 1, 0.0), (n + 8, rows[0][1], None, 0.0), (n + 9, [1.0, 2.0], 1, 0.0), (None, rows[0][1], 1, 0.0), (n + 10, [], 1, 0.0)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    """(n_links, component) of each row by brute force."""
    use = [i for i, r in enumerate(rows) if r["embedding"] and r["label"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    links = {i: set() for i in range(len(rows))}
    for i in use:
        for j in use:
            if i < j and rows[i]["label"] == rows[j]["label"] and len(rows[i]["embedding"]) == len(rows[j]["embedding"]):
                a, b = np.array(rows[i]["embedding"], float), np.array(rows[j]["embedding"], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j]["vec_id"] for j in seen if rows[j]["vec_id"] is not None]
        out.append((r["vec_id"], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 40])
def test_dedup_equals_brute_force(vectors, block):
    rows = vectors.collect()
    got = ed.near_duplicates(vectors, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == plain(rows)


def test_dedup_equals_sql(spark, data):
    rows = ed.op6_embedding_dedup(spark.read.parquet(f"{data}/embeddings.parquet"))
    assert spark_rows(rows) == duck_rows(data, ed.OP6_SQL)


def test_dedup_of_ten_thousand(spark):
    """10,000 vectors with 800 pairs between 0.93 and 0.97 and a group of 300: links against brute force, at most one
    in a thousand lost and none added."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8_100, 64))
    base = ed._units(x[:800])
    side = rng.normal(size=(800, 64))
    side = ed._units(side - (base * side).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.93, 0.97, (800, 1))
    x = np.concatenate([x, cosine * base + np.sqrt(1 - cosine**2) * side, x[5000] + rng.normal(0, 0.2, (300, 64)), x[:800]])
    frame = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score double")
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicates(frame).collect()}
    unit, want = ed._units(x), np.zeros(len(x), int)
    for start in range(0, len(x), 1000):
        want[start : start + 1000] = (unit[start : start + 1000] @ unit.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert len(got) == len(x) and (found <= want).all() and want.sum() - found.sum() <= 1e-3 * want.sum()


@pytest.mark.parametrize("n", [1_000, 10_000, 100_000, 1_000_000])
@pytest.mark.parametrize("dim", [8, 64])
def test_pairs_at_the_threshold_meet(n, dim):
    """60,000 random pairs at cosine 0.93: no more than 0.1% of them, and some room for chance, share no band."""
    rng = np.random.default_rng(4)
    bits, bands = ed.band_plan(n, 0.93, 1e-3)
    missed = 0
    for _ in range(12):
        a, b = ed._units(rng.normal(size=(5000, dim))), rng.normal(size=(5000, dim))
        b = ed._units(b - (a * b).sum(axis=1, keepdims=True) * a)
        x, y = (ed.band_keys(v, bits, bands, np.zeros(5000, np.int64)) for v in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b))
        missed += int((x != y).all(axis=1).sum())
    assert missed <= 60_000 * 1.5e-3


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x, y = ed._units(rng.normal(size=(300, 64))), ed._units(rng.normal(size=(300, 64)))
    turn = ed.rotations(64)
    sign, a = np.where(x @ turn > 0, 1, -1), x @ turn
    estimate = (sign * (y @ turn)).sum(axis=1) / (sign * a).sum(axis=1)
    error = estimate - (x * y).sum(axis=1)
    assert abs(error.mean()) < 0.02 and error.std() < 0.12


def test_search(spark, data, vectors):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in pi.op7_permutation_index(table).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = []
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        true = set(ids[np.argsort(-s)[:20]].tolist())
        hits.append(len(true & {v for v, _ in found.values()}) / 20)
        assert sorted(found) == list(range(1, 21))
        assert all(found[k][1] >= found[k + 1][1] for k in range(1, 20))
        assert all(abs(score - x[ids == v][0] @ x[ids == q][0]) < 1e-12 for v, score in found.values())
    assert np.mean(hits) >= 0.9


def test_search_in_blocks_and_odd_rows(spark, vectors):
    asks = F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))
    exact = spark_rows(pi.nearest(vectors, asks, share=1.0))
    assert spark_rows(pi.nearest(vectors, asks, share=1.0, block=50)) == exact
    assert pi.op7_permutation_index(vectors.limit(0)).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 1, 0.0), (21, [3.0, -1.0], 1, 0.0), (22, [3.0, -1.0], 1, 0.0), (40, [1.0] * 3, 1, 0.0)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pi.op7_permutation_index(one).collect())
    assert got == [(20, 1, 21, 1.0), (20, 2, 22, 1.0)]


@pytest.mark.parametrize("copies", [21, 22, 23, 25, 26, 27, 30, 31, 33])
def test_ties_go_to_smaller_ids(spark, copies):
    rng = np.random.default_rng(copies)
    one, query = rng.normal(size=64).tolist(), rng.normal(size=64).tolist()
    rows = [(20, query, 1, 0.0), *[(100 + i, one, 1, 0.0) for i in range(copies) if (100 + i) % 20], (7, one, 2, 0.0)]
    got = sorted((r["rank"], r["vec_id"]) for r in pi.op7_permutation_index(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [v for _, v in got] == sorted(r[0] for r in rows[1:])[:20]


@pytest.fixture(scope="module")
def many(spark):
    """More vectors than are ranked again: 12,000 random ones, and 700 copies of one among them."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 64)).astype(np.float32)
    x[500:1200] = x[500]
    return x, spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], SCHEMA).repartition(6)


def test_recall_where_the_index_excludes_most(many):
    """Of 12,000 vectors 5% are ranked again, and 0.9 of the nearest are among them; ties end at the smaller ids; the
    count, and the answer from other partitions, are the same."""
    x, table = many
    answer = pi.op7_permutation_index(table)
    got = {}
    for r in answer.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    wide, asked = x.astype(float), [i for i in range(len(x)) if i % 20 == 0 and not 500 <= i < 1200]
    hits = []
    for q in asked:
        s = wide @ wide[q]
        s[q] = -np.inf
        hits.append(len(set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) & set(got[q].values())) / 20)
    assert np.mean(hits) >= 0.9
    assert [got[500][k] for k in range(1, 21)] == list(range(501, 521))
    assert answer.count() == 20 * len([i for i in range(len(x)) if i % 20 == 0])
    again = {(r["query_id"], r["rank"]): r["vec_id"] for r in pi.op7_permutation_index(table.repartition(3, "vec_id")).collect()}
    assert again == {(q, k): v for q, found in got.items() for k, v in found.items()}


def test_only_cells_that_can_hold_better_are_searched(spark, monkeypatch):
    """Forty tight clusters: the answer in cells equals that of one block, and queries meet few cells."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = centre[np.arange(4000) % 40] * rng.uniform(0.9, 1.1, (4000, 1)) + rng.normal(0, 0.02, (4000, 16))
    frame = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, score double")
    asks = F.col("vec_id") % 20 == 0
    whole = spark_rows(pi.nearest(frame, asks, share=1.0, block=5000))
    visits, real = [], pi.cells_to_search

    def counted(*args):
        found = stored(real(*args), "visits")
        visits.append(found.count())
        return found

    monkeypatch.setattr(pi, "cells_to_search", counted)
    assert spark_rows(pi.nearest(frame, asks, share=1.0, block=100)) == whole
    assert visits[0] < 0.3 * 200 * 40


def test_footrule():
    """What a query adds up is half the footrule distance, taken from its maximum, with absent pivots at the end."""
    rng = np.random.default_rng(2)
    near = np.array([rng.permutation(12)[:6] for _ in range(40)])
    own = rng.permutation(12)[:6]
    place = lambda order, p: order.tolist().index(p) if p in order else 6
    plain = [sum(6 - max(place(own, p), place(row, p)) for p in range(12)) for row in near]
    assert pi.InvertedFiles(near, 12).nearness(own).tolist() == plain


def test_empty_dedup(vectors):
    assert ed.op6_embedding_dedup(vectors.limit(0)).count() == 0
