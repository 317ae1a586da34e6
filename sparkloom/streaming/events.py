"""Streams of events: filtering, windows, deduplication and upserts.

Each transformation takes and returns a DataFrame and works alike on streams and tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The actions that a pull-request event is handled for.
ACTIONS = ("opened", "synchronize", "reopened", "ready_for_review")
PAYLOAD = "action string, pull_request struct<number: int, draft: boolean, head: struct<sha: string>>, repository struct<full_name: string, clone_url: string>"


def read_events(spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def accepted(events: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Pull-request events to act on: a known action, not a draft, and all four fields there."""
    rows = events.where(F.col(kind) == "pull_request").withColumn("p", F.from_json(payload, PAYLOAD))
    number, sha, name, url = F.col("p.pull_request.number"), F.col("p.pull_request.head.sha"), F.col("p.repository.full_name"), F.col("p.repository.clone_url")
    rows = rows.where(F.col("p.action").isin(*ACTIONS) & ~F.coalesce(F.col("p.pull_request.draft"), F.lit(False)))
    return rows.where(number.isNotNull() & sha.isNotNull() & name.isNotNull() & url.isNotNull()).select(number.alias("number"), sha.alias("sha"), name.alias("repo"), url.alias("url"))


def by_window(events: DataFrame, key: str, value: str, ts: str = "ts", length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling or sliding window; events later than the watermark are dropped by streams."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "total")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def first_of_each(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of an upserted table, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return []
    done = [s.getPath() for s in files.listStatus(folder) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def current(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The newest finished version of an upserted table, empty if there is none."""
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def upsert(path: str, keys: list[str], order: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the newest row per key in a table, whatever is delivered twice.

    Every batch writes a version of its own beside the others and reads the newest finished one, so a stream that
    begins anew with another checkpoint goes on from what is there. A batch that comes again changes nothing, as the
    newest row of a key stays the newest. The last `keep` versions stay for readers, older ones go.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, path)
        newest = lambda rows: rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        newest(current(spark, path, batch.schema).unionByName(newest(batch))).write.mode("overwrite").parquet(f"{path}/v{found[-1] + 1 if found else 0}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for old in found[: max(0, len(found) + 1 - keep)]:
            gone = jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            gone.getFileSystem(conf).delete(gone, True)

    return write


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table in the folder; nothing is gathered in the
    driver. A complete result is that of the last batch."""
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out, checkpoint = f"{folder}/stream-{name}", f"{folder}/stream-checkpoint-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
