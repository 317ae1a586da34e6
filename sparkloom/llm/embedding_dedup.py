"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors of a label are one class. Every class is turned by random rotations into a code of sign bits; a stored
factor per class corrects the code's inner products, so that sign(Rx).Ry / factor(x) estimates <x, y> without bias.
Bands of further sign bits, each bit with a random direction of its own so that bits and bands are independent, deal
the classes to buckets; enough bands are used that a pair at the threshold meets with probability 1 - `miss`. A first pass over the buckets carries codes alone and keeps the classes that have a possible
partner there by the codes' Hamming distance. A second one brings the vectors of those: estimates and their
confidence bounds decide which pairs are recomputed exactly, in double precision. A pair counts in the first band it
shares only, so no pair is counted twice and no pair is ever a row: buckets send counts and a spanning forest.

Buckets of more than `block` classes are cut into blocks by hash and dealt out as pairs of blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing and are their own component; equal rows are members of one class and linked with each other; a null id
takes the smallest id of its component, or stays null; vectors of other lengths than most never meet; an empty table
gives an empty result; columns of any other name and type are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_side, stored
from .components import components
from .word_table import partitions_for

CODE_BITS = 256


def usable(vector: str):
    """True for vectors that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=8)
def rotations(dim: int, seed: int = 5) -> np.ndarray:
    """Random rotations side by side (dim by CODE_BITS or more)."""
    rng = np.random.default_rng(seed + dim)
    parts = []
    while sum(p.shape[1] for p in parts) < CODE_BITS:
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)[:, : max(CODE_BITS, dim)].astype(np.float32)


@lru_cache(maxsize=8)
def directions(dim: int, columns: int, seed: int = 3) -> np.ndarray:
    """Independent random directions (dim by columns)."""
    return np.random.default_rng((seed, dim)).normal(size=(dim, columns))


def band_plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits in a band, bands): buckets of about 4 unrelated vectors, and a pair at the threshold lost with `miss`."""
    bits = max(8, ceil(log2(max(n, 2))) - 2)
    p = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - p))


def band_keys(units: np.ndarray, bits: int, bands: int, label: np.ndarray) -> np.ndarray:
    """A 64-bit key of label, length, band and bits for each row and band; no two bands share a direction."""
    dim = units.shape[1]
    above = (units @ directions(dim, bits * bands) > 0).reshape(len(units), bands, bits)
    out = (above @ (1 << np.arange(bits))).astype(np.uint64)
    out = mixed(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(out ^ label.astype(np.uint64)[:, None] ^ np.uint64(dim))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's component among n rows with links a, b."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of the same bucket together; the rows come sorted by bucket, those alone in theirs are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = np.asarray(batch.column("bucket"))
        if held and bucket[0] != held[-1].column("bucket")[-1].as_py() or held and bucket[-1] != bucket[0]:
            cut = int(np.searchsorted(bucket != held[-1].column("bucket")[-1].as_py(), True)) if bucket[0] == held[-1].column("bucket")[-1].as_py() else 0
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            batch, bucket, held = batch.slice(cut), bucket[cut:], []
        if not held and bucket[-1] != bucket[0]:
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(bucket: np.ndarray, side: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) of rows that a bucket judges, about `most` at a time, or one bucket's: all of its pairs (side
    0), or those between its two blocks (sides 1 and 2). Rows come sorted by bucket."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    end = np.repeat(np.append(first[1:], len(bucket)), np.diff(np.append(first, len(bucket))))
    later = end - np.arange(len(bucket)) - 1  # rows after each in its bucket
    upto = np.cumsum(later)
    start = 0
    while start < len(bucket):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        n = later[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[a] != side[b]) | (side[a] == 0)
        if ok.any():
            yield a[ok], b[ok]
        start = stop


def _apart(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1)


def _dealt(rows: DataFrame, block: int, checked: int = 200_000) -> DataFrame:
    """rows (key, cls, ...) with `bucket` and `side`: keys of more than `block` rows become pairs of blocks."""
    big = stored(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "big")
    side = F.broadcast(big) if big.count() <= checked else big
    own = F.pmod(F.xxhash64(F.lit("block"), "cls"), F.col("blocks")).cast("int")
    rows = rows.join(side, "key", "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(own))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    bucket = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("bucket", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(bucket)).withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)).drop("blocks", "own", "other")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", miss: float = 1e-3, sigmas: float = 5.0, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id) of every row.

    `miss` is the chance that a pair exactly at the threshold meets in no band, and `sigmas` how many standard errors
    the confidence bounds leave to estimates: both say how much may be lost, at any size of the data.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull())
    # equal vectors of a label by two hashes, with one zero
    mark = lambda seed: F.when(F.col("ok"), F.xxhash64(F.lit(seed), "label", F.transform("v", lambda x: x + F.lit(0.0))))
    rows = stored(rows.withColumn("h1", mark(1)).withColumn("h2", mark(2)), "vectors")
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.count("*").alias("many"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    bits, bands = band_plan(n, threshold, miss)
    # codes of a pair at the threshold differ in this many bits at most, with room for `sigmas` standard errors
    rate = acos(threshold) / pi
    most_apart = CODE_BITS * rate + sigmas * (CODE_BITS * rate * (1 - rate)) ** 0.5

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("v").offsets))
            for dim in np.unique(sizes):
                whole = batch.filter(pa.array(sizes == dim))
                for start in range(0, whole.num_rows, 2048):
                    part = whole.slice(start, 2048)
                    units = _units(_matrix(part.column("v")))
                    k = band_keys(units, bits, bands, np.asarray(part.column("label_key")))
                    turned = units.astype(np.float32) @ rotations(int(dim))
                    packed = pa.array([c.tobytes() for c in np.packbits(turned[:, :CODE_BITS] > 0, axis=1)], pa.binary())
                    own = pa.array(np.repeat(np.arange(part.num_rows), bands))
                    yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), part.column("cls").take(own), packed.take(own)], ["key", "cls", "code"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
            need = np.zeros(table.num_rows, bool)
            for a, b in _pairs(np.asarray(table["bucket"]), np.asarray(table["side"])):
                hit = _apart(codes, a, b) <= most_apart
                need[a[hit]] = need[b[hit]] = True
            yield from table.select(["bucket", "side", "cls", "key"]).filter(pa.array(need)).to_batches()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _buckets(batches):
            sizes = np.asarray(pc.list_value_length(whole["v"]))
            for dim in np.unique(sizes).tolist():
                found = judged(whole.filter(pa.array(sizes == dim)), dim)
                if found is not None:
                    yield found

    def judged(table: pa.Table, dim: int) -> pa.RecordBatch | None:
        cls, many, side, bucket, label, key = (np.asarray(table[c]) for c in ("cls", "many", "side", "bucket", "label_key", "key"))
        units = _units(_matrix(table["v"].combine_chunks()))
        turned = units.astype(np.float32) @ rotations(dim)
        codes = np.packbits(turned[:, :CODE_BITS] > 0, axis=1).view(np.uint64)
        keys = np.concatenate([band_keys(units[i : i + 2048], bits, bands, label[i : i + 2048]) for i in range(0, len(units), 2048)])
        band = (keys == key.astype(np.uint64)[:, None]).argmax(axis=1)
        # unbiased estimates: sign code of one against the turned vector of the other
        sign = np.where(turned > 0, 1, -1).astype(np.float32)
        factor = (sign * turned).sum(axis=1)
        fit = factor / np.sqrt(turned.shape[1] * (turned * turned).sum(axis=1))
        spread = sigmas * np.sqrt(np.maximum(1 - fit * fit, 0) / (fit * fit) / (dim - 1 if dim > 1 else 1) / (turned.shape[1] / dim))
        room = spread * np.sqrt(max(0.0, 1 - threshold * threshold))
        left, right = [], []
        for all_a, all_b in _pairs(bucket, side):
            near = _apart(codes, all_a, all_b) <= most_apart
            all_a, all_b = all_a[near], all_b[near]
            for start in range(0, len(all_a), 20_000):
                a, b = all_a[start : start + 20_000], all_b[start : start + 20_000]
                first = (keys[a] == keys[b]).argmax(axis=1) == band[a]  # the first band that a pair shares judges it
                a, b = a[first], b[first]
                likely = np.einsum("ij,ij->i", sign[a], turned[b]) / factor[a] + room[a] >= threshold - 1e-6
                a, b = a[likely], b[likely]
                good = (units[a] * units[b]).sum(axis=1) >= threshold
                left.append(a[good])
                right.append(b[good])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if not len(a):
            return None
        links = (np.bincount(a, many[b], len(cls)) + np.bincount(b, many[a], len(cls))).astype(np.int64)
        low, at = _forest(a, b, len(cls)), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cls[at], links[at], cls[low[at]])], ["cls", "links", "root"])

    parts = partitions_for(n * bands, 400_000)
    coded = classes.select("cls", "many", "v", F.xxhash64(F.lit("label"), "label").alias("label_key"))
    banded = coded.mapInArrow(code, "key long, cls long, code binary")
    dealt = _dealt(banded, block)
    need = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "side", "cls", "key", "code").mapInArrow(possible, "bucket long, side int, cls long, key long")
    full = need.join(coded, "cls")
    found = full.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "side", "cls", "key", "label_key", "many", "v").mapInArrow(exact, "cls long, links long, root long")
    found = stored(found, "links")
    return _finish(rows, classes, found)


def _finish(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their class's links and the smallest id of its component."""
    linked = stored(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls"), "linked")
    members = classes.select("cls", "low").join(linked, "cls")
    smallest = small_side(members.groupBy("component").agg(F.min("low").alias("least")), "smallest")
    least = members.join(smallest, "component").select("cls", "component", "least")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    by_class = classes.select("h1", "h2", "cls", "many", "low").join(least, "cls", "left").join(links, "cls", "left")
    component_id = F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least"))
    by_class = by_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), component_id.alias("component_id"))
    out = rows.where("ok").join(by_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op6_embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_duplicates(vectors).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


OP6_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings
), l AS MATERIALIZED (
  SELECT a.k AS x, b.k AS y FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT k, vec_id AS reach, k AS at FROM v UNION SELECT r.k, v.vec_id, l.y FROM r JOIN l ON l.x = r.at JOIN v ON v.k = l.y
), m AS (SELECT k, min(reach) AS component_id FROM r GROUP BY k
), c AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM v JOIN m USING (k) LEFT JOIN c ON c.x = v.k
"""
