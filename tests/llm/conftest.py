import zlib

import pytest


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, and columns with clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the other cat", "en", "a", 50, 0.5, "x"),
        (1, "The cat sat on the mat and looked at the other cat", "en", "a", 50, 0.5, "x"),
        (2, None, "en", "a", None, 1.0, None),
        (3, "", None, None, 0, 0.0, ""),
        (None, " \t\n", "en", "b", 3, 0.1, "y"),
        (None, "one two", "en", None, 7, 0.2, "z"),
        (None, "one two", "en", None, 7, 0.2, "z"),
        (4, "12 34 ... !!", "xx", "b", 12, 0.3, "q"),
        (5, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "b", 300_000, 0.4, "long"),
        (None, None, None, None, None, None, None),
    ]
    clashing = ("label", "part", "__id", "__doc", "target", "source_size", "n", "cls", "words", "chunk", "bucket", "__found", "__c0", "size")
    rows = [(*r, *[f"{c} {i}" if i % 3 else None for c in clashing]) for i, r in enumerate(rows)]
    names = "".join(f", `{c}` string" for c in clashing)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string{names}")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
