import pytest
from comparison import duck_rows, spark_rows
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def test_equal_to_sql(docs, labels, data):
    assert spark_rows(mixing.op5_mixing(docs, labels)) == duck_rows(data, mixing.OP5_SQL)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"a": 0, "b": 7}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([("0" + k, float(v)) for k, v in sizes.items()], "__src string, source_size double")
    got = {r["__src"][1:]: r["target"] for r in mixing.targets(rows, (5, 2, 1), 1.5, 2.0).collect()}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, dict(zip(sorted(sizes), [5, 2, 1, 5, 2, 1], strict=False))
    while True:  # reshare the excess until no target is above its cap
        part = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in part if part[s] > 2 * sizes[s]]
        if not over:
            want |= part
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
            del open_[s]
    assert got == pytest.approx(want)


def test_taken(docs, labels):
    rows = mixing.op5_mixing(docs, labels)
    per = rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in per)
    assert rows.where("taken > 2 * size OR taken < 0").count() == 0
    assert spark_rows(rows) == spark_rows(mixing.op5_mixing(docs.repartition(7), labels))


def test_odd_rows(odd_docs, no_docs, labels):
    rows = mixing.op5_mixing(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert [r["size"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    assert abs(sum(r["taken"] for r in rows) - sum({r["source_size"]: r["target"] for r in rows}.values())) <= 4
    assert mixing.op5_mixing(no_docs, labels).count() == 0


def test_better_documents_are_taken_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("n"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("q"))
    got = mixing.mix(rows, F.col("n"), F.lit("s"), F.col("doc_id").cast("string"), F.col("q"), share=0.3, whole=True)
    good, bad = (got.where(f"q = {q}").agg(F.sum("__taken")).first()[0] for q in (4.0, 1.0))
    assert good > 2 * bad and abs(good + bad - 12_000) <= 10


def test_ranges_are_even_and_in_order(spark):
    """Whatever the qualities, no range has many times the rows of another, and ranges follow the keys."""
    rows = spark.range(20_000).select(F.lit("s").alias("__src"), F.lit(5).cast("long").alias("__size"), F.element_at(F.array(F.lit(0.02), F.lit(1.0), F.lit(50.0)), (F.col("id") % 3 + 1).cast("int")).alias("__quality"), F.col("id").cast("string").alias("__id"))
    rows = rows.withColumn("__key", mixing.draw_key(F.col("__id"), F.col("__size"), F.col("__quality"), 17))
    got = mixing.with_ranges(rows).groupBy("__range").agg(F.count("*").alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high")).orderBy("__range").collect()
    assert len(got) > 130 and max(r["n"] for r in got) < 220
    assert all(a["high"] < b["low"] for a, b in zip(got[:-1], got[1:], strict=True))
    even = sorted(map(tuple, mixing.mix(rows.select("__id"), F.lit(5).cast("long"), F.lit("s"), F.col("__id"), F.col("__id").cast("double") % 7 + 0.1, share=0.4).collect()))
    assert abs(sum(r[-1] for r in even) - 40_000) <= 1


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", 7.0, "x", 1), (2, "d e", None, 8.0, "y", 2)], "doc_id long, text string, source string, target double, source_size string, __src int")
    got = mixing.mix(rows, mixing.word_count(F.col("text")), F.col("source"), F.col("doc_id").cast("string"), F.lit(1.0))
    assert got.columns[:6] == rows.columns and sorted(r["target"] for r in got.select("target").collect()) == [7.0, 8.0]
