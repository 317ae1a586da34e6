import hashlib
import random

import numpy as np
import pytest

from sparkloom.operators import duplication as dup


def winnow_plain(hashes, w=5):
    if not hashes:
        return []
    if len(hashes) < w:
        return [hashes.index(min(hashes))]
    out = set()
    for s in range(len(hashes) - w + 1):
        part = hashes[s : s + w]
        out.add(s + max(i for i, h in enumerate(part) if h == min(part)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_winnowing(seed):
    rng = random.Random(seed)
    for _ in range(30):
        hashes = [rng.choice([*range(8), 2**64 - 1]) for _ in range(rng.choice([0, 1, 4, 5, 6, 40]))]
        assert dup.winnowed(np.array(hashes, np.uint64)).tolist() == winnow_plain(hashes)


def test_gram_hashes():
    tokens = ["a", "\u00e9t\u00e9", "", "b|c", *"defghij"]
    want = [int(hashlib.md5("|".join(tokens[i : i + 9]).encode()).hexdigest()[:16], 16) for i in range(len(tokens) - 8)]
    assert dup.gram_hashes(tokens).tolist() == want and len(dup.gram_hashes(tokens[:8])) == 0


def test_pairs_in_blocks(spark, monkeypatch):
    """Fingerprints of many documents: the same pairs, whatever the block."""
    rng = random.Random(9)
    rows = [(i, f"{h:02x}") for i in range(40) for h in rng.sample(range(12), 6)]
    prints = spark.createDataFrame(rows, "doc_id int, h string")
    whole = sorted(map(tuple, dup.pairs(prints, least=50.0).collect()))
    monkeypatch.setattr(dup, "BLOCK", 3)
    assert whole and sorted(map(tuple, dup.pairs(prints, least=50.0).collect())) == whole


def test_thirteen_shared_words_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("klmnopqr") for _ in range(6))
    shared = " ".join(word() for _ in range(13))
    docs = [(i, " ".join([*(word() for _ in range(i)), shared, *(word() for _ in range(3))])) for i in range(6)]
    prints = dup.fingerprints(spark.createDataFrame(docs, "doc_id int, text string"))
    assert dup.pairs(prints, least=0.0).count() == 15


def test_identical_and_distinct(spark):
    text = "\n".join(f"line {i} of the text goes here and there" for i in range(5))
    other = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, other), (4, None), (5, "")], "doc_id int, text string")
    prints = dup.fingerprints(docs)
    found = dup.pairs(prints)
    assert [(r["doc_a"], r["doc_b"], r["similarity"]) for r in found.collect()] == [(1, 2, 100.0)]
    lines = dup.duplicated_lines(dup.shared_ranges(prints, found), spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "doc_id int, loc long"))
    assert {r["doc_id"]: r["duplicated"] for r in lines.collect()} == {1: 5, 2: 5, 3: 0}


def test_ranges_merge_once(spark):
    rows = spark.createDataFrame([("x", 1, 3), ("x", 4, 6), ("x", 8, 9), ("x", 2, 2), ("y", 5, 5)], "k string, start int, end int")
    merged = dup.merge_ranges(rows, "k")
    expected = [("x", 1, 6), ("x", 8, 9), ("y", 5, 5)]
    assert sorted((r["k"], r["start"], r["end"]) for r in merged.collect()) == expected
    assert sorted((r["k"], r["start"], r["end"]) for r in dup.merge_ranges(merged, "k").collect()) == expected
