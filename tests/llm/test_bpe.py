import hashlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import bpe, packets

ODD = [
    "Hello  world\n\n  x <|endoftext|>  a's I'LL'll \u00a0\u3000\u00e9", None, "", "  ", "<|endoftext|><|endoftext|> ", "\u65e5\u672c\u8a9e 123\u0663 \u2003\u200b \x85 x\x1c y",
    "a" * 30_000 + " b" * 10, "\U0001f600 \U0001f468\u200d\U0001f469 \ufdfa \u01c5 \u2167 \u00b2 _ __a 'S 're''s \ufeff", "\x00\x01 \x7f  \U000e0001 \u180e",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def expected(tokenizer, rows):
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [2_000_000, 3])
def test_equal_to_the_library(spark, tokenizer, chunk):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[0]), (3, ODD[0]), (None, ODD[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in bpe.encode(df, bpe.default_vocabulary(), per_chunk=chunk).collect()), key=str)
    assert got == expected(tokenizer, rows)


def test_documents(docs, tokenizer):
    got = sorted((tuple(r) for r in bpe.op2_bpe(docs).collect()), key=str)
    assert got == expected(tokenizer, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(odd_docs, no_docs, tokenizer):
    got = sorted((tuple(r) for r in bpe.op2_bpe(odd_docs).collect()), key=str)
    assert got == expected(tokenizer, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert bpe.op2_bpe(no_docs).count() == 0


def test_round_trip_through_the_piece_join(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_vocabulary(), outputs=("ids",), per_chunk=5)
    got = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, bpe.default_vocabulary(), "doc_id").collect()}
    assert got == {i: t or "" for i, t in rows}


def test_packed_forms():
    """Everything that a packet holds comes back as it was."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        places = rng.integers(0, rng.choice([3, 255, 256, 257, 70_000, 1 << 24], n) if n else 1, n)
        assert packets.to_places(packets.from_places(places)).tolist() == places.tolist()
        words = pa.array(["".join(rng.choice(list("ab \u00e9\U0001f600"), int(rng.integers(0, 9)))) for _ in range(n)], pa.string())
        assert packets.to_words(packets.from_words(words)).equals(words)
        for most in (200, 1 << 17):
            lists = pa.array([rng.integers(0, most, int(rng.integers(0, 4))).tolist() for _ in range(n)], pa.list_(pa.int32()))
            assert packets.to_lists(packets.from_lists(lists)).to_pylist() == lists.to_pylist()
