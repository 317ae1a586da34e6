"""Documents as packets of word numbers: the position join that BPE encoding makes.

One pass splits the texts. Each task cuts its documents into chunks of a bounded number of words; a chunk numbers its
distinct words, the most frequent first, and holds its documents as packed numbers, in packets, with the columns to be
kept. The words go to hash parts, one packed row for each chunk and part, so that a word that stands in every document
is one entry per chunk, and each part has every distinct word of its own once. What a part answers returns, by number,
to the chunk that asked.

The chunks are written once and read for both ways: whatever order the documents come in, words and answers agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidied
from .word_table import partitions_for, split_words


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def squeezed(values: np.ndarray) -> bytes:
    """32-bit values as zstandard-compressed planes of their bytes."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def stretched(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return planes.T.copy().view(np.uint32).ravel().astype(np.int64)


def from_places(values: np.ndarray) -> bytes:
    """Word numbers: a byte each, and the rest of those from 255 on."""
    large = values >= 255
    common = zstandard.ZstdCompressor(level=1).compress(np.where(large, 255, values).astype(np.uint8).tobytes())
    return len(common).to_bytes(4, "little") + common + squeezed(values[large] - 255)


def to_places(blob: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(blob[:4], "little")
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:cut]), np.uint8).astype(np.int64)
    values[values == 255] += stretched(blob[cut:])
    return values


def from_words(words: pa.Array) -> bytes:
    """Words as one blob: their lengths and their bytes."""
    lengths = squeezed(np.asarray(pc.binary_length(words)))
    data = zstandard.ZstdCompressor(level=9).compress(b"".join(words.cast(pa.binary()).to_pylist()))
    return len(lengths).to_bytes(4, "little") + lengths + data


def to_words(blob: bytes) -> pa.Array:
    cut = 4 + int.from_bytes(blob[:4], "little")
    lengths, data = stretched(blob[4:cut]), zstandard.ZstdDecompressor().decompress(blob[cut:])
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def from_lists(lists: pa.ListArray) -> bytes:
    """Lists of non-negative integers as one blob. Words come in order of their bytes, so lists often begin alike."""
    lengths, flat = squeezed(np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())
    wide = 4 if len(flat) and flat.max() >= 1 << 16 else 2
    return len(lengths).to_bytes(4, "little") + bytes([wide]) + lengths + zstandard.ZstdCompressor(level=9).compress(flat.astype(f"<u{wide}").tobytes())


def to_lists(blob: bytes) -> pa.ListArray:
    cut, wide = 5 + int.from_bytes(blob[:4], "little"), blob[4]
    offsets = np.concatenate(([0], np.cumsum(stretched(blob[5:cut])))).astype(np.int32)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[cut:]), f"<u{wide}").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: Words seen so often in a chunk are numbered by frequency, which makes their places short; the others in the order of
#: their bytes, which makes the words short.
OFTEN = 8


def _chunk(held: list[pa.RecordBatch], coded: list[pa.DictionaryArray], lengths: np.ndarray, per_packet: int) -> Iterator[tuple]:
    """(chunk, seq, n_words, words, places, rows): the dictionary is seq 0, the packets of documents follow. `held` are
    the kept columns of the documents, `coded` their words, one dictionary a batch, `lengths` their numbers of words."""
    merged = pa.concat_arrays([c.dictionary for c in coded]).dictionary_encode()
    within, codes = np.asarray(merged.indices), np.empty(int(lengths.sum()), np.int32)
    start = first = 0
    for c in coded:
        codes[start : start + len(c)] = within[first : first + len(c.dictionary)][np.asarray(c.indices)]
        start, first = start + len(c), first + len(c.dictionary)
    words = merged.dictionary
    seen = np.bincount(codes, minlength=len(words))
    by_bytes = np.asarray(pc.sort_indices(words)).astype(np.int64)
    order = by_bytes[np.argsort(-np.where(seen >= OFTEN, seen, 0)[by_bytes], kind="stable")]
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    at, table = np.concatenate(([0], np.cumsum(lengths))), pa.Table.from_batches(held)
    chunk = uuid.uuid4().int >> 65
    yield chunk, 0, len(order), from_words(words.take(pa.array(order))), None, None
    first, seq = 0, 1
    while first < len(lengths):
        upto = max(first + 1, int(np.searchsorted(at, at[first] + per_packet, side="right")) - 1)
        rows = table.slice(first, upto - first).append_column("__length", pa.array(lengths[first:upto], pa.int64()))
        yield chunk, seq, 0, None, from_places(number[codes[at[first] : at[upto]]]), to_blob(rows.combine_chunks().to_batches()[0])
        first, seq = upto, seq + 1


def chunked(docs: DataFrame, text_col: str, keep: tuple[str, ...], per_chunk: int, per_packet: int = 200_000) -> DataFrame:
    """The stored chunks (chunk, seq, n_words, words, places, rows) of docs with the columns in `keep` as __0, __1, ..."""
    bounded_batches(docs.sparkSession)
    names = [f"__{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], split_words(F.col(text_col).cast("string")).alias("words"))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = ["chunk", "seq", "n_words", "words", "places", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, coded, lengths, total = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in _chunk(held, coded, np.concatenate(lengths), per_packet):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], columns)

        for batch in batches:
            if batch.num_rows:
                lists = batch.column("words")
                held.append(batch.select(names))
                coded.append(lists.flatten().dictionary_encode())
                lengths.append(np.asarray(pc.list_value_length(lists)).astype(np.int64))
                total += len(coded[-1])
            if total >= per_chunk:
                yield from flush()
                held, coded, lengths, total = [], [], [], 0
        if held:
            yield from flush()

    return stored(given.mapInArrow(tidied(run), "chunk long, seq int, n_words int, words binary, places binary, rows binary"), "chunks")


def answered(chunks: DataFrame, answer: Callable[[pa.Array], pa.ListArray], per_part: int = 500_000) -> DataFrame:
    """(chunk, numbers, answers): for each chunk and hash part, the numbers of the words it asked and, in the same
    order, the lists of integers that `answer` gives for the part's distinct words."""
    asked = chunks.where("seq = 0").select("chunk", "words", "n_words")
    total = asked.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    parts = partitions_for(total, per_part)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("words"), strict=True):
                words = to_words(blob.as_py())
                part = np.fromiter((crc32(w) % parts for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                rows = [(p, squeezed(np.diff(numbers, prepend=0)), from_words(words.take(pa.array(numbers)))) for p, numbers in zip(*_split(part[order], order), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "chunk", "numbers", "words"])

    def reply(key: tuple, rows: pa.Table) -> pa.Table:
        asks = [to_words(blob.as_py()) for blob in rows["words"]]
        flat = pa.concat_arrays(asks).dictionary_encode()
        made, at, out = answer(flat.dictionary), 0, []
        for words in asks:
            out.append(from_lists(made.take(flat.indices.slice(at, len(words)))))
            at += len(words)
        return pa.table({"chunk": rows["chunk"], "numbers": rows["numbers"], "answers": pa.array(out, pa.binary())})

    dealt = asked.select("chunk", "words").mapInArrow(tidied(deal), "part int, chunk long, numbers binary, words binary")
    return dealt.groupBy("part").applyInArrow(reply, "chunk long, numbers binary, answers binary")


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct sorted keys, and the values of each."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first].tolist(), np.split(values, first[1:]) if len(first) else []


def finished(chunks: DataFrame, replies: DataFrame, finish: Callable[[pa.ListArray], Callable[[np.ndarray, np.ndarray], list[pa.Array]]], schema: str, names: list[str]) -> DataFrame:
    """The documents with their kept columns and what `finish` makes of them.

    `finish` gets a chunk's answers in the order of the word numbers and returns a function of a packet's numbers and
    documents' first places (n + 1), which gives the new columns, named in `names` after the kept ones.
    """
    n = chunks.where("seq = 0").count()
    rows = chunks.where("seq > 0").select("chunk", "seq", "places", "rows").unionByName(replies.select("chunk", F.lit(0).alias("seq"), F.col("numbers").alias("places"), F.col("answers").alias("rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, answers, make = None, [], [], None
        for batch in batches:  # in order of chunk, its answers before its packets
            for chunk, seq, places, blob in zip(*(batch.column(c) for c in ("chunk", "seq", "places", "rows")), strict=True):
                if chunk.as_py() != at:
                    at, numbers, answers, make = chunk.as_py(), [], [], None
                if seq.as_py() == 0:
                    numbers.append(np.cumsum(stretched(places.as_py())))
                    answers.append(to_lists(blob.as_py()))
                    continue
                if make is None:
                    order = np.argsort(np.concatenate([np.zeros(0, np.int64), *numbers]), kind="stable")
                    make = finish(pa.concat_arrays(answers).take(pa.array(order)) if answers else pa.array([], pa.list_(pa.int32())))
                table = from_blob(blob.as_py())
                first = np.concatenate(([0], np.cumsum(np.asarray(table["__length"]))))
                kept = table.drop_columns(["__length"]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*kept.columns, *make(to_places(places.as_py()), first)], names)

    parts = min(max(12, 2 * n), 20_000)
    dealt = rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "seq")
    return dealt.mapInArrow(tidied(run), schema)
