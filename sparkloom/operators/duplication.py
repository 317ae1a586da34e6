"""Duplication by k-gram fingerprints: winnowing, an inverted-index join, and merged line ranges.

A document's k-grams and fingerprints are made within its Arrow batch, so that nothing is shuffled before the index
join; a fingerprint's hash is the first 64 bits of the MD5 of its tokens, joined by a bar, as hexadecimal digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import scoring

#: K-gram length, window, and the least similarity reported.
K, WINDOW, LEAST_SIMILARITY = 9, 5, 10.0
#: Documents of one fingerprint that meet in one task; more are cut into blocks.
BLOCK = 1000
_BLANKS = re.compile("[ \t\r]+")
_SCHEMA = "pos int, h string, first int, last int"


def words_with_lines(text: str | None) -> tuple[list[str], list[int]]:
    """A text's words and the lines they stand in, counted from 1."""
    words, lines = [], []
    for number, line in enumerate((text or "").split("\n"), 1):
        found = [w for w in _BLANKS.split(line) if w]
        words += found
        lines += [number] * len(found)
    return words, lines


def gram_hashes(tokens: list[str], k: int = K) -> np.ndarray:
    """The first 64 bits of every k-gram's digest, as numbers, which order as their digits do."""
    if len(tokens) < k:
        return np.zeros(0, np.uint64)
    parts = [t.encode() for t in tokens]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data, starts = b"|".join(parts), np.concatenate(([0], ends[:-1]))
    return np.frombuffer(b"".join([md5(data[a:b]).digest()[:8] for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=False)]), ">u8").astype(np.uint64)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sorted positions (from 0) of the selected k-grams: each window's least hash, the rightmost of equals; of fewer
    k-grams than a window, the leftmost least."""
    if len(hashes) < window:
        return np.array([hashes.argmin()] if len(hashes) else [], np.int64)
    parts = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(parts)) + window - 1 - parts.argmin(axis=1))


def _rows(docs: DataFrame, key: str, columns: list[str], tokens_of: Callable, chosen: Callable[[np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(key, pos, h, first, last) of the chosen k-grams of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, digits, first, last = [], [], [], [], []
            for row, values in enumerate(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
                tokens, lines = tokens_of(*values)
                hashes = gram_hashes(tokens, k)
                picked = chosen(hashes)
                use = picked.tolist()
                at += [row] * len(use)
                pos += use
                digits += [f"{h:016x}" for h in hashes[picked].tolist()]
                first += [lines[i] for i in use]
                last += [lines[i + k - 1] for i in use]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(digits, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], [key, "pos", "h", "first", "last"])

    docs, cores = docs.select(key, *columns), docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a few large files or row groups
        docs = docs.repartition(cores)
    return docs.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {_SCHEMA}")


def document_grams(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, pos, h, first, last) of all k-grams."""
    return _rows(docs, key, [text], words_with_lines, lambda hashes: np.arange(len(hashes)), k)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, h, first, last) of the winnowed k-grams of texts."""
    return _rows(docs, key, [text], words_with_lines, winnowed, K)


def token_fingerprints(docs: DataFrame, key: str) -> DataFrame:
    """(key, pos, h, first, last) of the winnowed k-grams of token lists (key, tokens, lines)."""
    return _rows(docs, key, ["tokens", "lines"], lambda tokens, lines: (tokens or [], lines or []), winnowed, K)


def pairs(prints: DataFrame, key: str = "doc_id", least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_a, doc_b, shared, similarity) of pairs that share fingerprints, by Jaccard of the fingerprint sets.

    Only fingerprints of two documents or more enter the self-join. The documents of one that very many share are cut
    into blocks, and block meets block. Pairs whose sizes alone rule the similarity out go before they are counted.
    """
    each = prints.select(F.col(key).alias("doc"), "h")
    sizes = each.distinct().groupBy("doc").agg(F.count("*").alias("n"))
    # fingerprints of two documents at least; the others, nearly all, go before anything else is joined
    often = each.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("df")).where("low <> high").select("h", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))
    common = each.join(often, "h").distinct().join(sizes, "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = common.select(F.col("doc").alias("doc_a"), F.col("n").alias("na"), "h", F.col("own").alias("x"), every.alias("y"))
    b = common.select(F.col("doc").alias("doc_b"), F.col("n").alias("nb"), "h", F.col("own").alias("y"), every.alias("x"))
    # the most that two sets can share is the smaller one
    possible = (F.col("doc_a") < F.col("doc_b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * (least - 0.1))
    shared = a.join(b, ["h", "x", "y"]).where(possible).groupBy("doc_a", "doc_b", "na", "nb").agg(F.count("*").alias("shared"))
    similarity = F.round(scoring.share(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared")) * 100, 1)
    return shared.select("doc_a", "doc_b", "shared", similarity.alias("similarity")).where(F.col("similarity") >= least)


def merge_ranges(ranges: DataFrame, *keys: str) -> DataFrame:
    """Ranges (start, end) merged where they overlap or touch; keys tell the series apart."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.distinct().withColumn("fresh", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_ranges(prints: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, other_id, start, end): for both sides of each pair, the merged line ranges of shared fingerprints."""
    p = prints.select(F.col(key).alias("doc_id"), "h", F.col("first").alias("start"), F.col("last").alias("end"))
    both = found.select(F.col("doc_a").alias("doc_id"), F.col("doc_b").alias("other_id")).union(found.select("doc_b", "doc_a"))
    theirs = p.select(F.col("doc_id").alias("other_id"), "h").distinct()
    hits = both.join(p, "doc_id").join(theirs, ["other_id", "h"])
    return merge_ranges(hits.select("doc_id", "other_id", "start", "end"), "doc_id", "other_id")


def duplicated_lines(ranges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, loc, duplicated): merged over all partners, at most the document's lines (doc_id, loc)."""
    merged = merge_ranges(ranges.select("doc_id", "start", "end"), "doc_id").groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))
    return docs.join(merged, "doc_id", "left").select("doc_id", "loc", F.least(F.coalesce("lines", F.lit(0)), F.col("loc")).cast("long").alias("duplicated"))
