import re

import corpus_pipeline as cp
from comparison import spark_rows
from pyspark.sql import functions as F
from test_ngram_join import plain

from sparkloom.llm.common import stored


def test_stages(spark, docs, data):
    """Each stage against its input: clean rows stay, one of each group, targets met, tokens of all that is left."""
    columns, kept = docs.columns, {}
    rows = docs
    for name, stage in cp.STAGES[:-1]:
        rows = kept[name] = stored(stage(spark, rows, data), "stage")
        assert rows.columns == columns
    language, toxic, unique, mixed = (kept[n] for n, _ in cp.STAGES[:-1])
    lettered = docs.where(F.rlike("text", F.lit(r"\p{L}"))).count()
    assert language.count() >= 0.95 * lettered
    groups = {k: c for k, _, c in plain([(r["doc_id"], r["text"]) for r in toxic.collect()])}
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for c in groups.values()})
    known = {r["doc_id"] for r in unique.collect()}
    assert {r["doc_id"] for r in mixed.collect()} <= known
    words = lambda df: df.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(unique)) <= 0.1 * words(unique)
    last = cp.STAGES[-1][1](spark, mixed, data)
    assert last.count() == mixed.count()


def test_odd_rows(spark, odd_docs, data):
    rows = stored(cp.near_duplicates(spark, odd_docs, data), "stage")
    assert rows.columns == odd_docs.columns and rows.where("doc_id = 1").count() == 1 and rows.where("text = 'one two'").count() == 1
    assert rows.where("text IS NULL OR text = ''").count() == 3
    assert len(spark_rows(cp.mixed(spark, rows, data))) >= 1
    assert cp.language(spark, odd_docs, data).where("doc_id IN (2, 3, 4)").count() == 0
    assert [name for name, _ in cp.STAGES][0] == "language ID" and re.search("BPE", cp.STAGES[-1][0])


def test_odd_rows_of_the_other_stages(spark, odd_docs, data):
    """Toxicity, mixing and encoding: what becomes of null and empty texts, repeated rows, null ids and other columns."""
    key = lambda r: (r["doc_id"], r["text"])
    given = sorted(map(key, odd_docs.collect()), key=str)
    judged = cp.toxic(spark, odd_docs, data)
    assert judged.columns == odd_docs.columns
    left = sorted(map(key, judged.collect()), key=str)
    assert [k for k in left if not (k[1] or "").strip()] == [k for k in given if not (k[1] or "").strip()]
    assert all(given.count(k) == left.count(k) for k in left)
    taken = cp.mixed(spark, odd_docs, data)
    assert taken.columns == odd_docs.columns and taken.where("text IS NULL OR trim(text) = ''").count() == 0
    assert {key(r) for r in taken.collect()} <= set(given)
    out = cp.tokens(spark, odd_docs, data).collect()
    assert len(out) == len(given) and sorted((r["doc_id"] for r in out), key=str) == sorted((k[0] for k in given), key=str)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out) and sum(r["n_tokens"] == 0 for r in out) == sum(not k[1] for k in given)


def test_mixed_texts_stay(spark, docs, data):
    """A clean text of several languages, none with half of its words, has a language and stays."""
    lead = {r["lang"]: r["text"] for r in docs.where("lang IS NOT NULL AND length(text) > 1500").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    assert len(lead) >= 3
    parts = [" ".join(t.split()[:n]) for t, n in zip([lead[k] for k in sorted(lead)], (50, 50, 50, 50), strict=False)]
    extra = docs.limit(1).withColumn("doc_id", F.lit(10**9).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(" ".join(parts)))
    assert cp.language(spark, docs.unionByName(extra), data).where(f"doc_id = {10**9}").count() == 1


def test_empty(spark, no_docs, data):
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, data).count() == 0
