"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots, in order. The pivots' inverted files hold, for the vectors of a
block, how far from the end of the list the pivot stands there (nothing for vectors that don't list it). A query walks
the files of its own pivots and adds up, for each vector, how much nearer the two orders are than orders without a
pivot in common: the footrule distance, taken from its maximum. The vectors of the least distance are ranked again by
the exact inner product, in double precision.

Pivots are a bounded sample; all vectors are indexed. For inner products of vectors of different lengths, vectors get
one more component that makes their norms equal, which keeps the order of inner products. Some of the pivots are the
centres of cells; cells of more than `block` vectors are cut into blocks by a hash of id and vector. A query first
searches its own cell. The k-th best found there, and how far a cell's vectors lie from its centre at most, tell which
other cells can hold anything better: only those are searched then. Where vectors form clusters these are few; where
they point everywhere, as random ones do, they are most. A block sends each query's best, so no more than k rows per
query and block travel, and the answer doesn't depend on how the rows come partitioned.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a query whose own row
is the only one finds nothing; fewer candidates than k are all returned; ties go to the smaller id, null ids last,
also where a tie reaches over the end of what is ranked again; repeated rows are candidates of each other; vectors are
compared with those of the same length only; columns of any other name and type are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .embedding_dedup import usable

NO_ID = np.iinfo(np.int64).max


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x / most with one more component, so that every row has norm 1."""
    x = x / most
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)


def orders(turned: np.ndarray, listed: int) -> np.ndarray:
    """Each row's `listed` nearest pivots, nearest first."""
    near = np.argpartition(-turned, listed - 1, axis=1)[:, :listed] if listed < turned.shape[1] else np.tile(np.arange(turned.shape[1]), (len(turned), 1))
    order = np.argsort(-np.take_along_axis(turned, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


class InvertedFiles:
    """For each pivot, over a block's rows: the length of the lists less the pivot's place, 0 where it isn't listed."""

    def __init__(self, near: np.ndarray, pivots: int):
        n, self.listed = near.shape
        self.files = np.zeros((pivots, n), np.uint16)
        for place in range(self.listed):
            self.files[near[:, place], np.arange(n)] = self.listed - place

    def nearness(self, own: np.ndarray) -> np.ndarray:
        """Of a query that lists the pivots `own`: half the footrule distance to each row, taken from its maximum."""
        out, part = np.zeros(self.files.shape[1], np.uint32), np.empty(self.files.shape[1], np.uint16)
        for place, pivot in enumerate(own.tolist()):
            out += np.minimum(self.files[pivot], np.uint16(self.listed - place), out=part)
        return out


def search_block(candidates: pa.Table, queries: pa.Table, pivots: list[np.ndarray], most: float, k: int, listed: int, asked: int, share: float) -> pa.Table:
    """(query_row, query_id, vec_id, score): each query's best k of a block."""
    out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    size = lambda t, c: np.diff(np.asarray((t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]).offsets)) if t.num_rows else np.zeros(0, np.int64)
    c_size, q_size = size(candidates, "v"), size(queries, "q_v")
    for dim in np.unique(q_size):
        c, q = candidates.filter(pa.array(c_size == dim)), queries.filter(pa.array(q_size == dim))
        if not c.num_rows:
            continue
        ids = np.array([NO_ID if i is None else i for i in c["vec_id"].to_pylist()], dtype=np.int64)
        order = np.argsort(ids, kind="stable")  # positions follow ids, for ties
        x, y, ids = _rows(c["v"])[order], _rows(q["q_v"]), ids[order]
        c_row, q_row, q_id = np.asarray(c["row"])[order], np.asarray(q["q_row"]), np.asarray(q["q_id"])
        own = np.array([p for p in pivots if len(p) == dim])
        few = max(20 * k, ceil(share * len(x)))
        index = None
        if len(own) >= 32 and few < len(x):
            p = lifted(own, most)
            index = InvertedFiles(orders(lifted(x, most) @ p.T, min(listed, len(p))), len(p))
            wanted = orders(_unit(y).astype(np.float32) @ p[:, :-1].T, min(asked, len(p)))
            later = np.arange(len(x), dtype=np.int64)
        for i in range(len(y)):
            at = np.arange(len(x)) if index is None else np.argpartition(later - index.nearness(wanted[i]).astype(np.int64) * len(x), few)[: few + 1]
            at = at[c_row[at] != q_row[i]]
            score = (x[at] * y[i]).sum(axis=1)  # by row in one order, so that equal vectors have equal scores
            best = np.lexsort((ids[at], -score))[:k]
            out["query_row"].append(np.full(len(best), q_row[i]))
            out["query_id"].append(np.full(len(best), q_id[i]))
            out["vec_id"].append(ids[at][best])
            out["score"].append(score[best])
    flat = {name: np.concatenate(v) if v else np.zeros(0, np.float64 if name == "score" else np.int64) for name, v in out.items()}
    return pa.table({"query_row": pa.array(flat["query_row"], pa.int64()), "query_id": pa.array(flat["query_id"], pa.int64()), "vec_id": pa.array(flat["vec_id"], pa.int64(), mask=flat["vec_id"] == NO_ID), "score": pa.array(flat["score"], pa.float64())})


def _unit(y: np.ndarray) -> np.ndarray:
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The lengths of a column's vectors, and the rows that have them."""
    size = np.asarray(pc.list_value_length(column))
    for dim in np.unique(size).tolist():
        yield dim, np.flatnonzero(size == dim)


def celled(rows: DataFrame, centres: list[np.ndarray], most: float) -> DataFrame:
    """rows (..., v) with the number of their nearest centre, -1 where none has their length, and the cosine with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cosine = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for dim, at in _by_size(batch.column("v")):
                own = [i for i, c in enumerate(centres) if len(c) == dim]
                if own:
                    near = lifted(_rows(batch.column("v").take(pa.array(at))), most) @ lifted(np.array([centres[i] for i in own]), most).T
                    cell[at], cosine[at] = np.array(own)[near.argmax(axis=1)], near.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(cosine, pa.float64())], [*batch.schema.names, "cell", "cosine"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell int, cosine double")


def cells_to_search(queries: DataFrame, centres: list[np.ndarray], widest: dict[int, float], most: float) -> DataFrame:
    """(q_row, q_id, q_v, to_cell) from queries (q_row, q_id, q_v, home, least): the cells but the own one that can hold
    a vector of at least the inner product `least`, null for any. `widest` is the cells' smallest cosine with their
    centres; the angle between query and vector is at least that of query and centre less that of centre and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([-np.inf if x is None else x for x in batch.column("least").to_pylist()])
            home, row, to = np.asarray(batch.column("home")), [], []
            for dim, at in _by_size(batch.column("q_v")):
                y = _rows(batch.column("q_v").take(pa.array(at)))
                norm, unit = np.sqrt((y * y).sum(axis=1)), _unit(y).astype(np.float32)
                for cell, cosine in widest.items():
                    if cell >= 0 and len(centres[cell]) != dim:
                        continue
                    best = np.full(len(at), np.inf)
                    if cell >= 0:
                        apart = np.arccos(np.clip(unit @ lifted(centres[cell][None], most)[0, :-1], -1, 1))
                        best = norm * most * (np.cos(np.maximum(0, apart - np.arccos(np.clip(cosine, -1, 1)))) + 1e-5)  # centres are in single precision
                    go = (best >= least[at]) & (home[at] != cell)
                    row.append(at[go])
                    to.append(np.full(int(go.sum()), cell))
            own = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("q_row", "q_id", "q_v")), pa.array(np.concatenate(to) if to else np.zeros(0, np.int64), pa.int32())], ["q_row", "q_id", "q_v", "to_cell"])

    return queries.select("q_row", "q_id", "q_v", "home", "least").mapInArrow(run, "q_row long, q_id long, q_v array<double>, to_cell int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector_col: str = "embedding", id_col: str = "vec_id", n_pivots: int = 512, listed: int = 256, asked: int = 64, share: float = 0.05, block: int = 16384, seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score). A vector lists `listed` pivots, a query asks `asked` of them; `share` of each
    block, at least 20 k rows, is ranked again exactly."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(usable("v")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if("asks").alias("asks")).first()
    # pivots come from a share of the vectors that a hash picks, equal ones once
    draw = F.xxhash64(F.lit(seed), "v")
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), "v"), F.lit(max(1, facts["n"] // (8 * n_pivots)))) == 0)
    pivots, most = [np.array(r["v"]) for r in some.select("v").distinct().orderBy(draw).limit(n_pivots).collect()], float(facts["norm"] or 1.0)
    centres = pivots[: ceil(facts["n"] / block)]
    rows = stored(celled(rows.drop("norm"), centres, most), "cells")
    cells = {r["cell"]: (r["n"], r["cosine"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine")).collect()}  # one row a centre
    subs = F.broadcast(spark.createDataFrame([(c, ceil(n / block)) for c, (n, _) in cells.items()], "to_cell int, subs int"))
    q_blocks = max(1, ceil(facts["asks"] / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    nameless = F.when(F.col("vec_id").isNull(), F.col("row"))  # rows without an id aren't told apart by it
    dealt = rows.join(subs, F.col("cell") == F.col("to_cell")).withColumn("sub", F.pmod(F.xxhash64(F.lit("c"), "vec_id", "v", nameless), F.col("subs")).cast("int"))
    candidates = dealt.select("vec_id", "row", "v", "cell", "sub").withColumn("qb", every(F.lit(q_blocks)))
    # names of their own: both sides read one table
    queries = rows.where("asks").select(F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.col("cell").alias("home"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, pivots, most, k, listed, asked, share)

    def search(sent: DataFrame) -> DataFrame:
        sent = sent.join(subs, "to_cell").withColumn("to_qb", F.pmod(F.xxhash64(F.lit("q"), "q_row"), F.lit(q_blocks)).cast("int")).withColumn("to_sub", every(F.col("subs"))).drop("subs")
        return candidates.groupBy("cell", "sub", "qb").cogroup(sent.groupBy("to_cell", "to_sub", "to_qb")).applyInArrow(run, "query_row long, query_id long, vec_id long, score double")

    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    found = search(queries.select("q_row", "q_id", "q_v", F.col("home").alias("to_cell")))
    if len(cells) > 1:
        found = stored(best(found).drop("rank"), "found")
        least = found.groupBy("query_row").agg(F.count("*").alias("m"), F.min("score").alias("s")).select(F.col("query_row").alias("q_row"), F.when(F.col("m") == k, F.col("s")).alias("least"))
        more = cells_to_search(queries.join(least, "q_row", "left"), centres, {c: cosine for c, (_, cosine) in cells.items()}, most)
        found = found.unionByName(search(more))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_permutation_index(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
