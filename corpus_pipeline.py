"""A corpus pipeline of five stages over `documents`, each one an operator of sparkloom.llm.

Language identification and toxicity drop what they reject, the n-gram join keeps one document of each group, mixing
repeats or drops documents by their source's target, and the last stage encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, language_id, mixing, ngram_join, toxicity
from sparkloom.llm.common import heap_returned, remainder, small_side, stored, tables


def _judged(docs: DataFrame, judge: Callable[..., DataFrame], condition: Column) -> DataFrame:
    """The rows of docs that meet a condition on the judge's columns; docs may have columns of any name."""
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()])
    text = next(n for n, c in own.items() if c == "text")
    return judge(plain, text_col=text, keep=tuple(own)).where(condition).select(*[F.col(n).alias(c) for n, c in own.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language; texts in several languages stay, whatever the main one's share.

    Null and empty texts, and those without a letter, have none and go; equal rows stay or go together; a null id is
    an id like others; columns of any name are carried.
    """
    model = language_id.train(docs.where(remainder("doc_id", 3) != 1))
    return _judged(docs, lambda d, **k: language_id.identify(d, model, **k), F.col("lang_pred") != language_id.UND)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be toxic.

    Null and empty texts hold no toxic word and stay; equal rows stay or go together; labels of unknown or null ids
    are ignored; columns of any name are carried.
    """
    rest = remainder("doc_id", 5)
    net = toxicity.train(docs.where(rest != 0), tables(spark, sf_dir, "labels").where(rest != 0))
    return _judged(docs, lambda d, **k: toxicity.score(d, net, **k), F.col("predicted") == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each linked group, and every document without a word.

    Rows are told apart by id and text; of rows equal in both, one stays, whatever its other columns. Null and empty
    texts link with nothing and stay; null ids come after all others. Keys to drop are broadcast if few.
    """
    found = stored(ngram_join.join(docs).where("n_shingles > 0"), "groups")
    keys = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("many"))
    rank = lambda: F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(rank()).alias("first"), F.max(rank()).alias("last")).where("first <> last").select("component", "first")
    first = small_side(first, "first", 200_000)  # groups of more than one key
    keys = stored(keys.join(first, "component", "left").withColumn("stays", F.col("first").isNull() | (rank() == F.col("first"))).select("doc_id", "text_hash", "many", "stays"), "keys")
    gone = small_side(keys.where("NOT stays").select("doc_id", "text_hash").distinct(), "gone", 1_000_000)
    twice = small_side(keys.where("stays AND many > 1").select("doc_id", "text_hash").distinct(), "twice", 1_000_000)
    mark = F.xxhash64(F.col("text"))
    same = lambda side: docs["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (mark == side["text_hash"])
    stay = docs.join(gone, same(gone), "left_anti")
    repeated = stay.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(twice, same(twice), "left_anti").unionByName(repeated)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole.

    Null and empty texts have no words and are not taken; equal rows count on their own; a null source is a source;
    documents without a label have quality 1; columns of any name are carried.
    """
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    at = {c: n for n, c in own.items()}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()])
    quality = small_side(mixing.label_quality(tables(spark, sf_dir, "labels")), "quality", 1_000_000)
    rows = plain.join(quality, F.col(at["doc_id"]) == F.col("__doc"), "left").drop("__doc")
    got = mixing.mix(rows, mixing.word_count(F.col(at["text"])), F.col(at["source"]), F.col(at["doc_id"]).cast("string"), F.coalesce("__q", F.lit(1.0)), whole=True)
    copies = F.when(F.col("__size") > 0, F.col("__taken") / F.col("__size")).otherwise(0).cast("int")
    return got.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).select(*[F.col(n).alias(c) for n, c in own.items()])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digests of ids and decoded text.

    A null text is an empty one, with no tokens; equal rows are encoded alike, each on its own; a null id is kept.
    """
    return bpe.encode(docs, bpe.default_vocabulary(), keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), per_chunk=2_000_000)


def _afresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun without the heap that the stages before it made the executors take."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        heap_returned(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", _afresh(language)),
    ("toxicity", _afresh(toxic)),
    ("n-gram Jaccard join", _afresh(near_duplicates)),
    ("mixing sources to target weights", _afresh(mixed)),
    ("BPE encoding and decoding", _afresh(tokens)),
]

#: Language ID and toxicity rest on trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; every stage's rows are written and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
