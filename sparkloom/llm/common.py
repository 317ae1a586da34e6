"""Helpers shared by the corpus operators: durable intermediate tables and text kernels."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Paths of the tables that `stored` has written, for `release`.
_WRITTEN: list[str] = []

#: How `stored` writes to local folders; other file systems don't read these. Hadoop starts a process for each folder
#: and file, to set permissions, and its usual class one more for a file of checksums. A process that a JVM starts
#: has all of its memory until it runs its command: an executor of 1.9 GB counts as one of 3.8 GB for that instant.
_NO_CHECKSUM_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session of one machine
    gets a folder of its own, and one of several machines is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here and survives lost executors.

    With `gather`, the few rows that many tasks make are moved into as few files as their size needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.hint("rebalance") if gather else df).write.options(**_NO_CHECKSUM_FILES).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(schema).parquet(path)


def stored_by_workers(df: DataFrame, function: Callable, schema: str, name: str) -> DataFrame:
    """df.mapInArrow(function, schema), stored. Where the shared folder is a local one, the Python workers write the files
    themselves, so that no executor starts a process for them (see above). A file is seen once its task has succeeded:
    it gets its visible name from the driver, which hears of it from that task alone."""
    spark = df.sparkSession
    scheme, _, folder = shared_folder(spark).partition(":")
    if scheme != "file":
        return stored(df.mapInArrow(function, schema), name)
    folder = f"/{folder.lstrip('/')}/sparkloom-{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    _WRITTEN.append(f"file://{folder}")
    kind = StructType.fromDDL(schema)
    columns = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        with pq.ParquetWriter(f"{folder}/.{file}", columns) as writer:
            for batch in function(batches):
                if batch.num_rows:
                    writer.write_table(pa.Table.from_batches([batch]).select(columns.names).cast(columns))
        yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    for row in df.mapInArrow(run, "file string").collect():
        os.rename(f"{folder}/.{row['file']}", f"{folder}/{row['file']}")
    return spark.read.schema(kind).parquet(f"file://{folder}")


def release(spark: SparkSession) -> None:
    """Delete all tables that `stored` has written, once no result that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """From now on Arrow batches of the session hold so many megabytes at most, or one row: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def small_side(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df stored; marked for broadcast if it has at most `most` rows, else left to a shuffled join."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= most else df


def heap_returned(spark: SparkSession) -> None:
    """The executors collect their garbage and give back the heap that work so far made them take: a heap grows with
    what is allocated, not with what is held, and without a full collection none of it is returned."""
    tasks = spark.sparkContext.defaultParallelism  # one for each core, so every executor has some
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def tidied(function: Callable) -> Callable:
    """The function, which maps batches to batches, and which gives memory back to the system as it goes: an executor's
    idle workers live on, and what their allocators keep adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: None)
        for out in function(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            trim(0)
        trim(0)

    return run


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo the modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def keep_share(threshold: Column, *cols: str) -> Column:
    """True for a share `threshold` (0 to 1) of the rows, decided by a hash of the given columns alone."""
    bits = F.xxhash64(F.lit("sparkloom"), *[F.col(c) for c in cols]).bitwiseAND(F.lit((1 << 40) - 1))
    return bits < F.floor(threshold * F.lit(float(1 << 40)))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- byte kernels

#: Bytes of a word for language and toxicity features: ASCII letters and everything above ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(97, 123), *range(65, 91), *range(128, 256)]] = True

#: Bytes that end a word under the contract's word pattern: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_KEY = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)


def powers(n: int) -> np.ndarray:
    """1, r, r^2, ... modulo 2^64 for an odd r."""
    out = np.full(max(n, 1), np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and the n + 1 offsets. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offs, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most_bytes: int = 1 << 18):
    """(start, length) of runs of texts of about most_bytes each; a longer text stands alone, whole. What a kernel needs
    for a slice is up to some eighty times its bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield start, i - start
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of bytes; nothing but the runs' own bytes enters it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    value = BYTE_KEY[data[within + np.repeat(starts, length)]] * powers(int(length.max()))[within]
    return mixed(np.add.reduceat(value, first) + length.astype(np.uint64))
