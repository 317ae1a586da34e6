"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct five-word shingles (tokens). Documents with the same set are one class. Two classes
link when 100 * |intersection| >= 75 * |union|. Tokens are ordered rare before frequent. A prefix of a set is long
enough when its rare tokens, plus the frequent tokens beyond the first of each combination group, outnumber the
tokens that a partner may lack; then similar sets share a rare token, or two frequent tokens of one group, in their
prefixes. So single rare tokens and pairs of frequent tokens of a group are the index keys, and passages that very
many documents share make no long posting lists unless documents consist of them.

Why: let x's prefix end no later in the order than y's. Common tokens in x's prefix are in y's as well. With no rare
one and at most one per group in common, x would lack at least (rare + sum over groups of (tokens - 1)) of its
prefix's tokens, which is more than a similar pair allows.

Groups are a hash of the token, their number set by the power of two below the set's size, so that the pairs stay in
proportion to the set. A set emits keys at each level that a partner's size can have; partners share a level.

The posting lists of one hub, the member that most lists have, are one neighbourhood: its members meet once, whatever
number of lists they share. Neighbourhoods of more than `block` members are cut into blocks by hash. Sizes and parity
sketches rule pairs out, both for certain. A round, or `rounds` of them with blocks cut anew, verifies a spanning forest
of each block's remaining pairs, the closest ones first; what they confirm becomes components. At last all remaining pairs of a
neighbourhood that lie in two components are verified, block against block, so no link between components is lost.

Tokens are compared as 64-bit hashes, sets by 126 bits. Index keys and the classes in posting lists are cut to as many
bits as the corpus needs: a clash adds a pair that verification refuses.

Defined cases: null texts and texts without a word have an empty set, size 0, link with nothing and are their own
component; with fewer than five words the whole sequence is the one shingle; a null id takes its class's smallest id,
and stays null without one; repeated rows are members of the same class; an empty table gives an empty result; columns
of any other name and type are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bounded_batches, joined_bytes, mixed, run_hashes, runs, slices, small_side, stored, tidied
from .components import components
from .word_table import partitions_for

SHINGLE = 5
_ODD = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for start, n in slices(texts):
        data, offsets = joined_bytes(texts.slice(start, n))
        data = LOWER[data]
        starts, ends = runs(~SPACE[data])
        words = run_hashes(data, starts, ends)
        at = np.searchsorted(starts, offsets)
        whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            whole += words[j : j + len(whole)] * _ODD[j]
        whole = mixed(whole)
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if last - first >= SHINGLE:
                out.append(np.unique(whole[first : last - SHINGLE + 1]))
            elif last > first:
                out.append(mixed((words[first:last] * _ODD[: last - first]).sum(keepdims=True) + np.uint64(last - first)))
            else:
                out.append(whole[:0])
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two 63-bit hashes of the set, which tell classes apart. (0, 0) is the empty set's."""
    if not len(tokens):
        return 0, 0
    one, two = mixed(tokens), mixed(tokens ^ np.uint64(0x5BF03635F0935AD1))
    total = mixed(np.array([one.sum(), np.bitwise_xor.reduce(one) + np.uint64(len(tokens)), two.sum(), np.bitwise_xor.reduce(two)], dtype=np.uint64))
    both = mixed(total[::2] * np.uint64(3) + total[1::2]) >> np.uint64(1)
    return int(both[0]) or 1, int(both[1]) or 1


def allowance(size: np.ndarray | int, percent: int):
    """How many tokens of a set of this size a similar set may lack."""
    return size - -(-size * percent // 100)


def levels(size: int, percent: int) -> range:
    """The levels of all sizes that a similar set can have."""
    return range(floor(log2(-(-size * percent // 100))), floor(log2(size * 100 // percent)) + 1)


def groups_of(level: int) -> int:
    return max(1, (1 << level) // 16)


def prefix_keys(tokens: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set; df is 0 for rare tokens and the rank class of frequent ones. Sets of one need none."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    need = allowance(n, percent) + 1
    rare = tokens[df == 0]  # in hash order
    keys = [rare[:need]]
    if len(rare) < need:
        frequent, own = tokens[df > 0], df[df > 0]
        frequent = frequent[np.lexsort((frequent, own))]
        for level in levels(n, percent):
            groups = groups_of(level)
            group = (frequent >> np.uint64(20)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            sorted_groups = group[order]
            seen_before = np.empty(len(group), np.int64)
            seen_before[order] = np.arange(len(group)) - np.searchsorted(sorted_groups, sorted_groups)
            worth = np.cumsum(seen_before > 0)
            end = int(np.searchsorted(worth, need - len(rare))) + 1
            used, of = frequent[:end], group[:end]
            order = np.argsort(of, kind="stable")
            used, of = used[order], of[order]
            for apart in range(1, len(used)):
                same = of[apart:] == of[:-apart]
                if not same.any():
                    break
                a, b = used[:-apart][same], used[apart:][same]
                keys.append(mixed(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(np.maximum(a, b) + np.uint64(level))))
    return np.unique(np.concatenate(keys))


def packed(sorted_values: np.ndarray) -> bytes:
    """Sorted 64-bit values as zstandard-compressed planes of their differences' bytes."""
    gaps = np.diff(sorted_values, prepend=np.zeros(1, sorted_values.dtype)).astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int64), pa.int64())


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits: how many tokens fall to each of sketch_bits(n) places, odd or even.

    Sets that differ in d tokens have sketches that differ in d bits at most, so a larger difference rules a pair out
    for certain. The halves of a sketch, added bit by bit, are the sketch of half as many bits.
    """
    bits = sketch_bits(len(tokens))
    return np.packbits(np.bincount(((tokens >> np.uint64(30)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_bits(n: int) -> int:
    """Two to four bits a token; sizes that can be similar differ by a factor of two in it at most."""
    return max(128, min(1 << 20, 2 << (max(1, n) - 1).bit_length()))


def sizes_and_classes(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text_hash, n, s1, s2, sketch) of every row; a task sends a class's sketch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = {(0, 0)}
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            marks = [signature(s) for s in sets]
            sketches = [sketch(s) if m not in seen and seen.add(m) is None else None for s, m in zip(sets, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), _longs([len(s) for s in sets]), _longs([m[0] for m in marks]), _longs([m[1] for m in marks]), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n", "s1", "s2", "sketch"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(tidied(run), "doc_id long, text_hash long, n long, s1 long, s2 long, sketch binary")


def frequent_tokens(docs: DataFrame, text_col: str, total: int, most: int, least_df: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted token values, their frequency class, shift): the tokens in most documents, at most `most` of them.

    Counted over all documents, a task's equal sets once, on hashes cut to log2(total) + 9 bits: each task sends, for
    each range of hashes, its distinct values and counts as one packed row. A cut hash can only make a token look more
    frequent than it is.
    """
    bits = min(62, ceil(log2(max(total, 2))) + 9)
    shift, n_ranges = 64 - bits, partitions_for(total, 2_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << bits) // n_ranges for i in range(n_ranges + 1)], dtype=np.uint64)

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
            cut = np.searchsorted(values, bounds)
            rows = [(i, packed(values[a:b]), zstandard.ZstdCompressor(level=1).compress(n[a:b].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "tokens", "counts"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                mark = signature(s)
                if mark not in seen:
                    seen.add(mark)
                    held.append(s)
                    size += len(s)
            if size > 3_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def merge(key, rows):
        tokens, n = [], []
        for t, c in zip(rows["tokens"], rows["counts"], strict=True):
            tokens.append(unpacked(t))
            n.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel())
        tokens, n = np.concatenate(tokens), np.concatenate(n).astype(np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, n = tokens[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        df = np.add.reduceat(n, first)
        keep = df >= least_df
        return pd.DataFrame({"token": tokens[first][keep].astype(np.int64), "df": df[keep]})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(count), "part int, tokens binary, counts binary")
    counts = stored(rows.groupBy("part").applyInPandas(merge, "token long, df long"), "tokens", gather=True)
    level = F.floor(F.log2(F.col("df").cast("double")) * 2).cast("int")
    bins = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, least = 0, 1 << 30
    for at, n in bins:
        if kept + n > most:
            break
        kept, least = kept + n, at
    got = counts.where(level >= least).select("token", level.alias("level")).toArrow()
    tokens, own = np.asarray(got["token"]).astype(np.uint64), np.asarray(got["level"]).astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], own[order], shift


def classes_of(tokens: np.ndarray, frequent: np.ndarray, level: np.ndarray, near: np.ndarray, shift: int) -> np.ndarray:
    """0 for rare tokens, else the frequency class; `near` is a bitmap that rules most rare ones out."""
    out = np.zeros(len(tokens), np.int64)
    cut = tokens >> np.uint64(shift)
    maybe = np.flatnonzero(near[(cut & np.uint64(len(near) - 1)).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(frequent, cut[maybe]), len(frequent) - 1)
        hit = frequent[at] == cut[maybe]
        out[maybe[hit]] = level[at[hit]]
    return out


def posting_lists(docs: DataFrame, text_col: str, frequent: tuple[np.ndarray, np.ndarray, int], percent: int, total: int, id_bits: int) -> DataFrame:
    """(list, id): posting lists of two or more members, equal lists of a part once. `id` is s1 cut to id_bits.

    A task posts each class once and sends, for each range of keys, one packed row of its sorted keys and their ids.
    """
    bits = min(63, ceil(log2(max(total, 2))) + 10)
    parts = partitions_for(total / 4, 750_000)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, level, shift = shared.value
        bounds = np.array([(i << bits) // parts for i in range(parts + 1)], dtype=np.uint64)
        near = np.zeros(1 << 24, bool)
        near[(tokens & np.uint64(len(near) - 1)).astype(np.int64)] = True

        def flush(keys: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
            key, own = np.concatenate(keys), np.repeat(np.array(ids, np.uint64), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            cut = np.searchsorted(key, bounds)
            rows = [(i, packed(key[a:b]), zstandard.ZstdCompressor(level=1).compress(own[a:b].view(np.uint8).reshape(-1, 8).T.tobytes())) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "ids"])

        seen: set[tuple[int, int]] = {(0, 0)}
        keys, ids, size = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                mark = signature(s)
                if mark in seen:
                    continue
                seen.add(mark)
                keys.append(prefix_keys(s, classes_of(s, tokens, level, near, shift), percent) >> np.uint64(64 - bits))
                ids.append(mark[0] >> (63 - id_bits))
                size += len(keys[-1])
            if size > 2_000_000:
                yield flush(keys, ids)
                keys, ids, size = [], [], 0
        if size:
            yield flush(keys, ids)

    def merge(group: tuple, rows: pa.Table) -> pa.Table:
        key = np.concatenate([unpacked(b.as_py()) for b in rows["keys"]])
        own = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py()), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel() for b in rows["ids"]])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        length = np.diff(np.append(first, len(order)))
        order = order[np.repeat(length > 1, length)]  # most keys have one member
        key, own = key[order], own[order]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))) if len(key) else np.zeros(0, bool)
        key, own = key[fresh], own[fresh]
        if not len(key):
            return pa.table({"list": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(first, len(key)))
        place = (np.arange(len(key)) - np.repeat(first, length)).astype(np.uint64)
        name = mixed(np.add.reduceat(mixed(own + place * np.uint64(0x9E3779B97F4A7C15)), first))
        _, once = np.unique(name, return_index=True)
        use = np.zeros(len(first), bool)
        use[once] = True
        use &= length > 1
        return pa.table({"list": _longs(np.repeat(name[use], length[use]).view(np.int64)), "id": _longs(own[np.repeat(use, length)])})

    posted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(post), "part int, keys binary, ids binary")
    return posted.groupBy("part").applyInArrow(merge, "list long, id long")


class Sketches:
    """The sketches of a block's members, given in order of size; `apart` compares one with those after it."""

    def __init__(self, blobs: list[bytes]):
        self.bits = np.array([8 * len(b) for b in blobs])
        self.planes: dict[int, tuple[int, np.ndarray]] = {}
        for bits in np.unique(self.bits).tolist():
            first, end = np.searchsorted(self.bits, (bits, 2 * bits + 1)).tolist()
            rows = np.empty((end - first, bits // 64), np.uint64)
            for i in range(first, end):
                own = np.frombuffer(blobs[i], np.uint64)
                rows[i - first] = own if len(own) == rows.shape[1] else own[: len(own) // 2] ^ own[len(own) // 2 :]
            self.planes[bits] = first, rows

    def apart(self, i: int, upto: int) -> np.ndarray:
        """In how many bits the sketches of i + 1 to upto - 1 differ from that of i, of the coarser one's bits."""
        first, rows = self.planes[int(self.bits[i])]
        return np.bitwise_count(rows[i + 1 - first : upto - first] ^ rows[i - first]).sum(axis=1).astype(np.int64)


def possible_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, blobs: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, apart): pairs of a block's rows, given in order of size, in different components that sizes and sketches
    allow; with sides 1 and 2 only pairs between them."""
    sketches, left, right, by = Sketches(blobs), [], [], []
    upto = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n) - 1):
        here = slice(i + 1, upto[i])
        ok = comp[here] != comp[i]
        if side[i]:
            ok &= side[here] != side[i]
        if not ok.any():
            continue
        apart = sketches.apart(i, int(upto[i]))
        j = np.flatnonzero(ok & (apart * (100 + percent) <= (n[here] + n[i]) * (100 - percent)))
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j + i + 1)
            by.append(apart[j])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, by))


def closest_forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of the components, the closest pairs first."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    _, own = np.unique(comp, return_inverse=True)
    taken = np.zeros(len(a), bool)
    while True:
        at = np.flatnonzero(own[a] != own[b])
        if not len(at):
            return order[taken]
        best = np.full(len(comp), len(a))
        np.minimum.at(best, own[a[at]], at)
        np.minimum.at(best, own[b[at]], at)
        best = np.unique(best[best < len(a)])
        taken[best] = True
        x, y = own[a[best]], own[b[best]]
        low = np.arange(len(comp))
        while True:  # the smallest number that each component is now linked with
            least = np.minimum(low[x], low[y])
            new = low.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        own = low[own]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket; the rows come sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("bucket")[0].as_py() != bucket[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def candidates(dealt: DataFrame, sketches: DataFrame, percent: int, forest: bool, parts: int) -> DataFrame:
    """(a, b, bucket) of classes to verify, each pair once, from rows (bucket, side, cls, n, comp): all possible pairs
    of a bucket, or a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            cls, once = np.unique(np.asarray(table["cls"]), return_index=True)
            n, comp, side = (np.asarray(table[c])[once].astype(np.int64) for c in ("n", "comp", "side"))
            order = np.argsort(n, kind="stable")
            cls, n, comp, side = cls[order], n[order], comp[order], side[order]
            a, b, apart = possible_pairs(n, comp, side, table["sketch"].take(pa.array(once[order])).to_pylist(), percent)
            if forest and len(a):
                use = closest_forest(a, b, apart / (n[a] + n[b]), comp)
                a, b = a[use], b[use]
            if len(a):
                yield pa.RecordBatch.from_arrays([_longs(np.minimum(cls[a], cls[b])), _longs(np.maximum(cls[a], cls[b])), _longs(np.full(len(a), table["bucket"][0].as_py()))], ["a", "b", "bucket"])

    rows = dealt.join(sketches, "cls").select("bucket", "side", "cls", "n", "comp", "sketch")
    rows = rows.repartition(max(6, parts), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidied(run), "a long, b long, bucket long").groupBy("a", "b").agg(F.min("bucket").alias("bucket"))


def neighbourhoods(placed: DataFrame) -> DataFrame:
    """(part, cls, n, comp): the classes of all lists that have the same most connected member, once each."""
    hubs = placed.groupBy("list").agg(F.max(F.struct("deg", "cls")).alias("hub")).select("list", F.col("hub.cls").alias("part"))
    return placed.join(hubs, "list").select("part", "cls", "n", "comp").distinct()


def cut_anew(near: DataFrame, large: DataFrame, block: int, seed: int) -> DataFrame:
    """(bucket, side, cls, n, comp): neighbourhoods cut into blocks by a hash, with the hub in each of them."""
    rows = near.join(large, "part", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col("blocks")).cast("int")
    at = F.when(F.col("cls") == F.col("part"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.withColumn("at", F.explode(at)).select(F.xxhash64("part", "at").alias("bucket"), F.lit(0).alias("side"), "cls", "n", "comp")


def block_against_block(near: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(bucket, side, cls, n, comp): every pair of a neighbourhood's classes in different components shares a bucket.

    Of a large neighbourhood, the members of the component that has most of them need to meet only the others.
    """
    most = near.join(large, "part", "left_semi").groupBy("part", "comp").agg(F.count("*").alias("k")).groupBy("part").agg(F.max(F.struct("k", "comp")).alias("most"))
    stats = small_side(large.join(most, "part").select("part", F.col("most.comp").alias("main"), F.ceil(F.col("most.k") / block).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("most.k")) / block).cast("int").alias("others")), "large")
    rows = near.join(stats, "part", "left")
    small = rows.where("main IS NULL").select(F.xxhash64("part").alias("bucket"), F.lit(0).alias("side"), "cls", "n", "comp")
    hashed = lambda n: F.pmod(F.xxhash64(F.lit("block"), "cls"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    inside, outside = rows.where("comp = main").withColumn("own", hashed("mains")), rows.where("comp <> main").withColumn("own", hashed("others"))
    out = ("cls", "n", "comp")
    crossed = inside.withColumn("at", F.explode(upto("others"))).select(F.xxhash64("part", F.lit("x"), "own", "at").alias("bucket"), F.lit(1).alias("side"), *out)
    crossing = outside.withColumn("at", F.explode(upto("mains"))).select(F.xxhash64("part", F.lit("x"), "at", "own").alias("bucket"), F.lit(2).alias("side"), *out)
    among = outside.withColumn("at", F.explode(upto("others"))).select(F.xxhash64("part", F.lit("y"), F.least("own", "at"), F.greatest("own", "at")).alias("bucket"), F.when(F.col("own") == F.col("at"), 0).when(F.col("own") < F.col("at"), 1).otherwise(2).alias("side"), *out)
    return small.unionByName(crossed).unionByName(crossing).unionByName(among)


def class_sets(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(s1, s2, tokens) of the classes in `wanted` (low, text_hash), from one document each, packed.

    The keys of those documents are broadcast if they are few enough, else the documents meet them in a shuffle. A
    repeated id may bring a class that isn't wanted; a task sends each class once.
    """
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.col("text").isNotNull())
    named = small_side(wanted.where("low IS NOT NULL").select(F.col("low").alias("id")).distinct(), "reps", 1_000_000)
    # classes all of whose rows have no id are found by their text
    nameless = small_side(wanted.where("low IS NULL").select("text_hash").distinct(), "nameless", 1_000_000)
    without = given.where(F.col("id").isNull()).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = {(0, 0)}
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column("text")):
                mark = signature(s)
                if mark not in seen:
                    seen.add(mark)
                    rows.append((*mark, packed(s)))
            yield pa.RecordBatch.from_arrays([_longs([r[0] for r in rows]), _longs([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], ["s1", "s2", "tokens"])

    found = given.join(named, "id", "left_semi").select("text").unionByName(without.join(nameless, "text_hash", "left_semi").select("text"))
    return found.mapInArrow(tidied(run), "s1 long, s2 long, tokens binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str, id_col: str, percent: int, most: int = 500) -> DataFrame:
    """The pairs (a, b, bucket) that link; a bucket gets each of its sets once, before its pairs. A bucket of more than
    `most` pairs is dealt out by their first class."""
    many = small_side(pairs.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > most), "many")
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / most))
    pairs = pairs.join(many, "bucket", "left").select("a", "b", F.when(F.col("m").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", part)).alias("bucket"))
    need = pairs.select("bucket", F.col("a").alias("cls")).union(pairs.select("bucket", "b")).distinct()
    need = stored(need.join(classes.select("cls", "s1", "s2", "low", "text_hash"), "cls"), "need", gather=True)
    n = need.count()
    sets = class_sets(docs, need.select("low", "text_hash").distinct(), text_col, id_col)
    slim = need.select("bucket", "cls", "s1", "s2")
    shipped = sets.join(F.broadcast(slim) if n <= 1_000_000 else slim, ["s1", "s2"]).select("bucket", F.col("cls").alias("a"), F.lit(0).cast("long").alias("b"), "tokens")
    rows = shipped.unionByName(pairs.select("bucket", "a", "b", F.lit(None).cast("binary").alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            left, right = [], []
            for where, a, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "tokens")), strict=True):
                if where != at:
                    at, held = where, {}
                if tokens is not None:
                    held[a] = unpacked(tokens)
                    continue
                x, y = held[a], held[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * 100 >= percent * (len(x) + len(y) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([_longs(left), _longs(right)], ["a", "b"])

    dealt = rows.repartition(max(6, ceil(n / 10_000)), "bucket").sortWithinPartitions("bucket", F.col("tokens").isNull())
    return dealt.select("bucket", "a", "b", "tokens").mapInArrow(tidied(run), "a long, b long")


def _open(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(list, cls, n, deg, comp) of the lists whose members lie in more than one component."""
    rows = listed.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    open_ = rows.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("list")
    return rows.join(open_, "list", "left_semi").select("list", "cls", "n", "deg", "comp")


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 75, most_frequent: int = 1 << 19, rounds: int = 2, block: int = 512) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of every row.

    component tells the linked groups of non-empty sets apart; component_id is the smallest id in it. text_hash is
    Spark's xxhash64 of the text. `most_frequent` bounds the broadcast of frequent tokens, `block` what meets at once.
    """
    bounded_batches(docs.sparkSession)
    members = stored(sizes_and_classes(docs, text_col, id_col), "members")
    classes = members.where("n > 0").groupBy("s1", "s2").agg(F.min("n").alias("n"), F.min("doc_id").alias("low"), F.min("text_hash").alias("text_hash"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("many")).first()
    frequent = frequent_tokens(docs, text_col, facts["total"], most_frequent)
    id_bits = min(63, ceil(log2(max(facts["many"], 2))) + 8)
    lists = posting_lists(docs, text_col, frequent, percent, facts["total"], id_bits)
    by_id = classes.select(F.shiftright("s1", 63 - id_bits).alias("id"), "cls", "n")
    listed = stored(lists.distinct().join(by_id, "id").select("list", "cls", "n"), "lists")
    listed = stored(listed.join(listed.groupBy("cls").agg(F.count("*").cast("int").alias("deg")), "cls").withColumn("comp", F.col("cls")), "lists")
    wanted = classes.join(listed.select("cls").distinct(), "cls").select("s1", "s2", "cls")
    sketches = members.where("sketch IS NOT NULL").select("s1", "s2", "sketch").join(wanted, ["s1", "s2"])
    sketches = stored(sketches.groupBy("cls").agg(F.first("sketch").alias("sketch")), "sketches")
    links, placed, found, seed, last = None, listed, None, 0, False
    while not last and (found is None or not placed.isEmpty()):
        near = stored(neighbourhoods(placed), "near")
        large = small_side(near.groupBy("part").agg(F.count("*").alias("m")).where(F.col("m") > block), "large")
        # a further forest is for neighbourhoods that were cut
        last = seed > 0 and (seed >= rounds or large.isEmpty())
        dealt = block_against_block(near, large, block) if last else cut_anew(near, large, block, seed)
        pairs = stored(candidates(dealt, sketches, percent, forest=not last, parts=ceil(near.count() / 50_000)), "pairs")
        more = stored(verified(pairs, classes, docs, text_col, id_col, percent), "links", gather=True)
        links = more if links is None else links.unionByName(more)
        found = stored(components(links), "linked")
        if not last:
            placed = stored(_open(listed.drop("comp"), found), "open")
        seed += 1
    # ids: the smallest of each class, then of each component; most classes are one of their own
    linked = classes.select("cls", "low").join(found.withColumnRenamed("node", "cls"), "cls")
    smallest = small_side(linked.groupBy("component").agg(F.min("low").alias("least")), "smallest")
    least = linked.join(smallest, "component").select("cls", "component", "least")
    by_class = classes.select("s1", "s2", "cls", "low").join(least, "cls", "left")
    by_class = by_class.select("s1", "s2", F.coalesce("component", "cls").alias("component"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    slim = members.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "s1", "s2")
    out = slim.where("n_shingles > 0").join(by_class, ["s1", "s2"]).select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = slim.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(-1).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def op8_ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return join(docs).select("doc_id", "n_shingles", "component_id")


#: The same rows in DuckDB, by a plain self-join and its transitive closure over classes of equal sets.
OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d
), c AS MATERIALIZED (
  SELECT min(doc_id) AS rep, g, len(g) AS n, md5(array_to_string(g, chr(1))) AS h FROM s WHERE len(g) > 0 GROUP BY g
), t AS MATERIALIZED (SELECT rep, n, unnest(g) AS tok FROM c
), tt AS MATERIALIZED (SELECT rep, n, tok FROM t WHERE tok IN (SELECT tok FROM t GROUP BY tok HAVING count(*) > 1)
), e AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM tt a JOIN tt b ON a.tok = b.tok AND a.rep <> b.rep AND a.n * 100 >= b.n * 75 AND b.n * 100 >= a.n * 75
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (SELECT rep, rep AS reach FROM c UNION SELECT r.rep, e.y FROM r JOIN e ON e.x = r.reach
), m AS MATERIALIZED (SELECT rep, min(reach) AS component_id FROM r GROUP BY rep)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.g) > 0 AND c.h = md5(array_to_string(s.g, chr(1))) LEFT JOIN m ON m.rep = c.rep
"""
