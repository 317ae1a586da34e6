"""Splitting texts into words, and the distinct-word table that token counting joins back.

Words are split in Spark by the byte-level tokenizer's pattern. Each distinct word is handled once. Its answer goes
back to the places it stands at in two ways that together cover every word: the words seen most, up to a fixed number
and length, travel to the executors as one broadcast; all others meet their places in a shuffled join. (BPE encoding
joins all words back; see packets.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored_by_workers, tidied

END_OF_TEXT = "<|endoftext|>"
#: White space as the tokenizer's pattern knows it.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def split_words(text: Column) -> Column:
    """The text's words in order; the special token's string is a word of its own and ends what stands before it."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    segments = F.transform(
        F.split(text, r"<\|endoftext\|>", -1),
        lambda part, i: F.concat(F.when(i > 0, F.array(F.lit(END_OF_TEXT))).otherwise(F.array().cast("array<string>")), F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))),
    )
    return F.when(F.contains(text, F.lit(END_OF_TEXT)), F.flatten(segments)).otherwise(plain)


def _packed(counts: dict[str, int], parts: int) -> pa.RecordBatch:
    """A row for each hash part: its words, sorted, with counts, as a compressed Arrow stream."""
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for word in counts:
        dealt[crc32(word.encode()) % parts].append(word)
    rows = []
    for part, words in enumerate(dealt):
        if words:
            words.sort()
            sink = pa.BufferOutputStream()
            batch = pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array([counts[w] for w in words], pa.int64())})
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            rows.append((part, sink.getvalue().to_pybytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "words"])


def distinct_words(docs: DataFrame, text_col: str, held: int = 1_000_000) -> DataFrame:
    """(word, n), stored: every distinct word and how often it stands in the corpus.

    Each task counts its words (up to `held` of them before it sends what it has) and sends them packed, by hash
    part; a part adds up what it gets. A word is at most one entry per task and part, so none is a hot spot.
    """
    # by the plan's estimate of the input where it has one, within a range that the session's setting spans
    size = int(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * usual if size >= 1 << 60 else min(64 * usual, max(4 * usual, size >> 26))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column("words").flatten())
            for word, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > held:
                yield _packed(counts, parts)
                counts = {}
        if counts:
            yield _packed(counts, parts)

    def total(blobs: list[pa.Scalar]) -> pa.RecordBatch:
        tables = [pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in blobs]
        found = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).combine_chunks()
        return pa.table({"word": found["word"], "n": found["n_sum"]}).to_batches()[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:  # sorted, so a part's rows are neighbours
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("words"), strict=True):
                if part != at and blobs:
                    yield total(blobs)
                    blobs = []
                at = part
                blobs.append(blob)
        if blobs:
            yield total(blobs)

    packed = docs.select(split_words(F.col(text_col)).alias("words")).mapInArrow(count, "part int, words binary")
    dealt = packed.repartition("part").sortWithinPartitions("part")
    return stored_by_workers(dealt, tidied(add), "word string, n long", "words")


@dataclass
class Head:
    """The broadcast part of a word table: at most `most` words of at most `longest` bytes, with further columns."""

    table: pa.Table
    place: dict | None = None

    def places(self, words: pa.Array) -> np.ndarray:
        """Row of each word in the table, -1 for words that aren't in it."""
        if self.place is None:
            self.place = {w: i for i, w in enumerate(self.table["word"].to_pylist())}
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words.to_pylist()), dtype=np.int64, count=len(words))


def split_head(table: DataFrame, most: int = 1 << 18, longest: int = 48, parts: int = 8, very: int = 1 << 14, longer: int = 1024) -> tuple[Head, Column]:
    """The head of a stored word table, collected with the most frequent word first, and the condition for the others.

    Words are ranked by the bin of their count's logarithm, so that a histogram of a few hundred rows decides. Words of
    up to `longer` bytes enter as well if they make up one in `very` words or more, which at most `very` of them can:
    a long word that very many documents hold is no join key either.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * parts).cast("int")
    short = F.octet_length("word") <= longest
    bins = sorted(((r["level"], r["words"]) for r in table.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, 64 * parts
    for at, words in bins:
        if total + words > most:
            break
        total, least = total + words, at
    all_ = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    inside = (short & (level >= least)) | ((F.octet_length("word") <= longer) & (F.col("n") > all_ / very) & (F.lit(most) > 0))
    return Head(table.where(inside).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).drop_columns(["n"])), ~inside


def partitions_for(rows: float, each: float) -> int:
    return max(12, ceil(rows / each))


