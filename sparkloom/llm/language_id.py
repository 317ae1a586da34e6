"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed four-byte grams, learned from labelled documents. A document is a
mixture of languages: every word is drawn from one of them, and expectation-maximisation estimates the proportions
from the words' gram likelihoods. Languages enter the document's set, in order of their proportion, as long as the
gain in log-likelihood exceeds a penalty for one more free proportion.

Defined cases: a null text or one without a letter is `und` with score 0; without any labelled text every document
is `und`; rows are judged one by one, so repeated rows get the same answer, and train once; columns of any other name
and type are ignored, or carried as they are if `keep` names them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, bounded_batches, joined_bytes, keep_share, remainder, runs, slices, small_side, stored, tidied

UND = "und"
BITS = 16


@dataclass
class LanguageModel:
    """langs, and log P(gram | language) as an array of languages by 2^BITS."""

    langs: list[str]
    logp: np.ndarray


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram buckets of all word bytes, the first gram of each word, and each text's first word (n + 1)."""
    data, offsets = joined_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    mask = LETTER[data]
    starts, _ = runs(mask)
    at = np.flatnonzero(mask)
    kept = np.zeros(len(data) + 3, dtype=np.uint32)
    kept[2 : len(data) + 2] = np.where(mask, data, 0)
    h = kept[at] * np.uint32(0x85EBCA6B) + kept[at + 1] * np.uint32(0xC2B2AE35)
    h += kept[at + 2] * np.uint32(0x27D4EB2F) + kept[at + 3] * np.uint32(0x165667B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, starts), np.searchsorted(starts, offsets)


def word_scores(model: LanguageModel, texts: pa.Array, temper: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word in each language (languages by words), and each text's first word (n + 1)."""
    h, word_at, text_at = grams(texts)
    if not len(word_at):
        return np.zeros((len(model.langs), 0), np.float32), text_at
    rows = [np.add.reduceat(row[h], word_at) for row in model.logp]
    return np.asarray(rows, dtype=np.float32).reshape(len(rows), -1) * np.float32(temper), text_at


def single_best(model: LanguageModel, texts: pa.Array) -> np.ndarray:
    """The index of the likeliest single language of each text; 0 where it has no word."""
    out = np.zeros(len(texts), dtype=np.int64)
    for start, n in slices(texts):
        scores, at = word_scores(model, texts.slice(start, n))
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            out[start + full] = np.add.reduceat(scores, at[full], axis=1).argmax(axis=0)
    return out


def _em(like: np.ndarray, first: np.ndarray, count: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after up to `rounds` steps and each document's log-likelihood less its words' maxima. A document
    stops when its own proportions stand still, whatever others are with it."""
    live = np.ones(pi.shape[1], bool)
    for _ in range(rounds):
        part = np.repeat(pi, count, axis=1) * like
        part /= np.maximum(part.sum(axis=0), 1e-30)
        new = (np.add.reduceat(part, first, axis=1) / count).astype(np.float32)
        moved = np.abs(new - pi).max(axis=0)
        pi = np.where(live, new, pi)
        live &= moved >= 2e-3
        if not live.any():
            break
    total = np.log(np.maximum((np.repeat(pi, count, axis=1) * like).sum(axis=0), 1e-30))
    return pi, np.add.reduceat(total.astype(np.float64), first)


def mixtures(scores: np.ndarray, at: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Proportions (languages by texts) over the language set chosen for each text; all zero without a word."""
    k, n = len(scores), len(at) - 1
    out = np.zeros((k, n), dtype=np.float32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full) or not k:
        return out
    top = scores.max(axis=0)
    like = np.exp(scores - top)
    first, count = at[full], (at[1:] - at[:-1])[full]
    alone = np.add.reduceat((scores - top).astype(np.float64), first, axis=1)
    best = alone.argmax(axis=0)
    chosen = np.zeros((k, len(full)), dtype=np.float32)
    chosen[best, np.arange(len(full))] = 1
    value = alone.max(axis=0)
    pi, _ = _em(like, first, count, np.full((k, len(full)), 1 / k, dtype=np.float32), rounds)
    rank = np.argsort(np.argsort(-pi, axis=0, kind="stable"), axis=0, kind="stable")
    open_ = np.arange(len(full))
    for size in range(2, k + 1):
        # a mixture can't beat the words' maxima: texts whose best set is closer than the penalty are settled
        open_ = open_[-value[open_] > 0.5 * penalty * np.log(count[open_] + 1)]
        if not len(open_):
            break
        words = np.repeat(first[open_], count[open_]) + (np.arange(count[open_].sum()) - np.repeat(np.cumsum(count[open_]) - count[open_], count[open_]))
        begin = np.where(rank[:, open_] < size, np.maximum(pi[:, open_], 1e-6), 0).astype(np.float32)
        at_ = np.cumsum(count[open_]) - count[open_]
        got, gain = _em(like[:, words], at_, count[open_], begin / begin.sum(axis=0), rounds)
        better = gain - value[open_] > 0.5 * penalty * np.log(count[open_] + 1)
        chosen[:, open_[better]] = got[:, better]
        value[open_[better]] = gain[better]
        open_ = open_[better]
    out[:, full] = chosen
    return out


def _count_map(text_col: str, label_col: str, model=None):
    """Gram counts by label, one batch at a time; with a model, of the texts only whose label it confirms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column(text_col), np.array(batch.column(label_col).to_pylist(), dtype=object)
            if model is not None:
                labels = np.where(np.array(model.value.langs, dtype=object)[single_best(model.value, texts)] == labels, labels, None)
            for start, n in slices(texts):
                h, word_at, text_at = grams(texts.slice(start, n))
                gram_at = np.append(word_at, len(h))[text_at]
                own = labels[start : start + n]
                of = np.repeat(np.arange(n), gram_at[1:] - gram_at[:-1])
                for lang in {x for x in own if x is not None}:
                    hit = np.bincount(h[(own == lang)[of]], minlength=1 << BITS)
                    total[lang] = total.get(lang, 0) + hit
        for lang, hit in total.items():
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(hit[at], pa.int64())], ["lang", "gram", "n"])

    return tidied(run)


def _fit(counts: DataFrame, alpha: float) -> LanguageModel:
    """The smoothed model; what reaches the driver is at most languages x 2^BITS counts."""
    got = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    n = np.full((len(langs), 1 << BITS), alpha)
    if len(langs):
        n[np.searchsorted(langs, got["lang"].to_numpy(dtype=str)), got["gram"].to_numpy()] += got["n"].to_numpy()
    return LanguageModel([str(x) for x in langs], np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_per_lang: int = 3000, most_langs: int = 128, alpha: float = 0.5) -> LanguageModel:
    """Learn the languages from labelled documents.

    The model is fitted on a sample bounded by `sample_per_lang` documents a language (in expectation), picked by a
    hash of id and text, equal rows once. `most_langs` bounds the languages: those with most labelled rows, ties by
    name. A second round leaves out documents whose label the first round's model contradicts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("__lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("__lang").isNotNull())
    sizes = rows.groupBy("__lang").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__lang").limit(most_langs)
    share = F.lit(float(sample_per_lang)) / F.col("__n")
    sample = rows.join(small_side(sizes, "langs"), "__lang").where(keep_share(share, "__id", "text")).select(F.col("__lang").alias("lang"), "text", "__id")
    sample = stored(sample.dropDuplicates().select("lang", "text").repartition(16), "langid")
    schema = "lang string, gram int, n long"
    first = _fit(sample.mapInArrow(_count_map("text", "lang"), schema), alpha)
    if len(first.langs) < 2:
        return first
    shared = spark.sparkContext.broadcast(first)
    second = _fit(sample.mapInArrow(_count_map("text", "lang", shared), schema), alpha)
    return second if len(second.langs) == len(first.langs) else first


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = 1.0) -> DataFrame:
    """The columns in `keep`, and lang_pred, score (the share of lang_pred in the text) and n_langs (size of the set).

    Only the text goes to Python, and only the answer comes back; all other columns stay where they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.langs, UND], dtype=object)
        for texts in batches:
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            pred, score, size = np.full(len(texts), len(m.langs)), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            if m.langs:
                for start, n in slices(texts):
                    pi = mixtures(*word_scores(m, texts.slice(start, n)), penalty)
                    here = slice(start, start + n)
                    pred[here], score[here], size[here] = pi.argmax(axis=0), pi.max(axis=0), (pi > 0).sum(axis=0)
            pred[~lettered], score[~lettered], size[~lettered] = len(m.langs), 0.0, 0
            yield pa.StructArray.from_arrays([pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(size, pa.int32())], ["lang_pred", "score", "n_langs"])

    def judge_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(run)(batches)

    judge = F.arrow_udf(judge_all, "lang_pred string, score double, n_langs int").asNondeterministic()  # so that it runs once a row
    found = docs.select(*keep, judge(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*keep, "__found.lang_pred", "__found.score", "__found.n_langs")


def op1_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_langs of every document; learned from rows that are not held out."""
    rest = remainder("doc_id", 3)
    model = train(docs.where(rest != 1))
    return identify(docs, model).select("doc_id", (rest == 1).alias("held_out"), "lang_pred", "score", "n_langs")
