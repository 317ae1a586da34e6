"""Commit logs as changes, from the text of a log with numstat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text

RECORD, FIELD = "\x01", "\x02"


def read_log(spark, path: str) -> DataFrame:
    """One row per commit of a log file written with RECORD before each commit."""
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record")


def changes(records: DataFrame, suffix: str = ".py") -> DataFrame:
    """(sha, author, email, ts, local_date, path, ins, dels) from records `sha FIELD author FIELD email FIELD date`
    and numstat lines. Bad headers and dates, binary files and other files go; authors default to the email."""
    lines = F.split("record", "\n")
    head = F.split(F.element_at(lines, 1), FIELD)
    rows = records.where(F.length(F.trim("record")) > 0).select(head.alias("head"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))
    rows = rows.where(F.size("head") >= 4)
    part = lambda i: F.trim(F.element_at("head", i))
    stat: Column = F.split("line", "\t", 3)
    email = F.lower(part(3))
    rows = rows.select(part(1).alias("sha"), F.when(part(2) != "", part(2)).otherwise(email).alias("author"), email.alias("email"), F.try_to_timestamp(part(4)).alias("ts"), F.substring(part(4), 1, 10).try_cast("date").alias("local_date"), stat.alias("stat"))
    rows = rows.where((F.size("stat") == 3) & F.col("ts").isNotNull())
    path = F.replace(text.renamed_path(F.element_at("stat", 3)), F.lit("\\"), F.lit("/"))
    rows = rows.select("sha", "author", "email", "ts", "local_date", path.alias("path"), F.element_at("stat", 1).try_cast("int").alias("ins"), F.element_at("stat", 2).try_cast("int").alias("dels"))
    return rows.where(F.col("ins").isNotNull() & F.col("dels").isNotNull() & F.endswith(F.col("path"), F.lit(suffix)))
