"""Toxicity scoring by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings: of the whole word and of its first 3 to 6 bytes, so that inflected forms of a
stem share most of their embedding. Filters of one, two and three words slide over the document, max pooling keeps
each filter's strongest answer, and a logistic unit weighs them. On all held-back labelled rows, of whatever length, a
threshold is chosen for each language, with the language guessed from the text alone; the executors score those rows
and send counts by language, label and logit. Scores are shifted so that the threshold is 0.5.

Defined cases: null and empty texts, and texts without a word, score as a document without any toxic word; without
positive or without negative labels every score is 0; rows are judged one by one, so repeated rows get the same
answer; labels of null or unknown documents are ignored, repeated ones count as toxic if one of them says so; columns
of any other name and type are ignored, or carried as they are if `keep` names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id
from .common import BYTE_KEY, LETTER, bounded_batches, joined_bytes, keep_share, mixed, powers, remainder, run_hashes, runs, slices, small_side, stored, tidied

BITS = 17
PREFIXES = (3, 4, 5, 6)
FEATURES = 1 + len(PREFIXES)
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PAD = max(WIDTHS)
#: Logits are counted in steps of 1 / STEPS up to MOST for the thresholds; training embeds about so many words at once.
STEPS, MOST = 256, 100
AT_ONCE = 50_000


@dataclass
class Net:
    """Embeddings (2^BITS by DIM); taps (DIM by FILTERS for each place of each width); biases; the last layer."""

    emb: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray | None = None
    languages: language_id.LanguageModel | None = None


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words by FEATURES) and each text's first word (n + 1)."""
    data, offsets = joined_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = runs(LETTER[data])
    at = np.searchsorted(starts, offsets)
    columns = [run_hashes(data, starts, ends)]
    total, r = np.zeros(len(starts), np.uint64), powers(max(PREFIXES))
    length = ends - starts
    for i in range(max(PREFIXES)):
        inside = length > i
        total = total + np.where(inside, BYTE_KEY[data[np.where(inside, starts + i, 0)]] * r[i], np.uint64(0)) if len(starts) else total
        if i + 1 in PREFIXES:
            columns.append(mixed(total + np.uint64(i + 1)))
    return np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], axis=1), at


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row of each word in an array with PAD empty rows after each text; each text's first row; rows in all.

    Windows may start at a text's words or at its first empty row: they end before the next text.
    """
    n = at[1:] - at[:-1]
    first = at[:-1] + PAD * np.arange(len(n))
    rows = np.arange(int(n.sum())) + np.repeat(PAD * np.arange(len(n)), n)
    return rows, first, int(n.sum()) + PAD * len(n)


def _answers(net: Net, x: np.ndarray) -> np.ndarray:
    """Filter answers at each row of the embedded words x, a width's places summed."""
    shots = x @ net.taps.reshape(DIM, -1)
    out, tap = [], 0
    for width in WIDTHS:
        y = np.zeros((len(x), FILTERS), x.dtype)
        for j in range(width):
            part = shots[j:, tap * FILTERS : (tap + 1) * FILTERS]
            y[: len(part)] += part
            tap += 1
        out.append(y)
    return np.concatenate(out, axis=1) + net.bias


def embedded(net: Net, words: np.ndarray, rows: np.ndarray, total: int) -> np.ndarray:
    x = np.zeros((total, DIM), net.emb.dtype)
    e = net.emb[words[:, 0]]
    for k in range(1, FEATURES):
        e += net.emb[words[:, k]]
    x[rows] = e
    return x


def logits(net: Net, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last layer's value for each text; every text has at least its empty rows."""
    if len(at) < 2:
        return np.zeros(0)
    rows, first, total = _places(at)
    ends = first + at[1:] - at[:-1] + 1
    pooled = np.maximum.reduceat(_answers(net, embedded(net, words, rows, total)), np.stack([first, ends], axis=1).ravel(), axis=0)[::2]
    return np.maximum(pooled, 0) @ net.out + net.out_bias


class Packed(Sequence):
    """Documents' word features, packed until they are asked for."""

    def __init__(self, blobs: Sequence[bytes]):
        self.blobs, self.unpack = blobs, zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.blobs)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(self.blobs[i]), np.int32).reshape(-1, FEATURES)


def _portions(docs: Sequence[np.ndarray], part: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The documents in `part` in portions of about AT_ONCE words; a longer one stands alone, whole."""
    own, held, total = [], [], 0
    for i in part:
        d = docs[i]
        if own and total + len(d) > AT_ONCE:
            yield np.array(own), held
            own, held, total = [], [], 0
        own.append(i)
        held.append(d)
        total += len(d)
    if own:
        yield np.array(own), held


def _tap_of() -> tuple[np.ndarray, np.ndarray]:
    """Each filter's first tap and its width."""
    return np.concatenate([[sum(WIDTHS[:i])] * FILTERS for i in range(len(WIDTHS))]), np.repeat(WIDTHS, FILTERS)


def gradients(net: Net, docs: Sequence[np.ndarray], y: np.ndarray, part: np.ndarray) -> dict:
    """The gradients of the mean logistic loss over the documents in `part`: arrays like the net's, for the embeddings
    the distinct rows touched and theirs."""
    tap_of, wide = _tap_of()
    g_taps, g_bias, g_out, g_out_bias = np.zeros_like(net.taps), np.zeros_like(net.bias), np.zeros_like(net.out), 0.0
    touched, pulls = [np.zeros((0, FEATURES), np.int32)], [np.zeros((0, DIM), net.emb.dtype)]
    for own, held in _portions(docs, part):
        at = np.concatenate(([0], np.cumsum([len(d) for d in held])))
        words = np.concatenate(held)
        rows, first, total = _places(at)
        x = embedded(net, words, rows, total)
        a = _answers(net, x)
        ends = first + at[1:] - at[:-1] + 1
        top = np.stack([a[s:e].argmax(axis=0) + s for s, e in zip(first, ends, strict=True)])
        pooled = np.take_along_axis(a, top, axis=0)
        z = np.clip(np.maximum(pooled, 0) @ net.out + net.out_bias, -30, 30)
        d = ((1 / (1 + np.exp(-z)) - y[own]) / len(part)).astype(net.emb.dtype)
        back = d[:, None] * net.out * (pooled > 0)
        word_at = np.full(total, -1)
        word_at[rows] = np.arange(len(rows))
        for j in range(max(WIDTHS)):
            live = np.flatnonzero(wide > j)
            at_row = np.minimum(top[:, live] + j, total - 1)
            g = back[:, live]
            for c, f in enumerate(live):
                g_taps[:, tap_of[f] + j, f % FILTERS] += g[:, c] @ x[at_row[:, c]]
            pulled = g[:, :, None] * net.taps[:, tap_of[live] + j, live % FILTERS].T[None]
            hit = (word_at[at_row] >= 0) & (g != 0)
            touched.append(words[word_at[at_row][hit]])
            pulls.append(pulled[hit])
        g_bias += back.sum(axis=0)
        g_out += (d[:, None] * np.maximum(pooled, 0)).sum(axis=0)
        g_out_bias += d.sum()
    buckets, inverse = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
    g_emb = np.zeros((len(buckets), DIM), net.emb.dtype)
    np.add.at(g_emb, inverse, np.repeat(np.concatenate(pulls), FEATURES, axis=0))
    return {"buckets": buckets, "emb": g_emb, "taps": g_taps, "bias": g_bias, "out": g_out, "out_bias": np.float32(g_out_bias)}


def fresh(rng: np.random.Generator, buckets: int = 1 << BITS) -> Net:
    """A net before training."""
    width = len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.02, (buckets, DIM)).astype(np.float32)
    taps = rng.normal(0, 0.1, (DIM, sum(WIDTHS), FILTERS)).astype(np.float32)
    return Net(emb, taps, np.zeros(width, np.float32), rng.normal(0, 0.05, width).astype(np.float32), -2.0)


def begun_at_odds(net: Net, docs: Sequence[np.ndarray], y: np.ndarray) -> None:
    """One dimension of the embedding starts as the bucket's log-odds between the classes, where three documents or more
    hold it, and one filter reads it: with few labelled documents, random weights learn their words by heart."""
    seen = np.zeros((2, len(net.emb)))
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d)] += 1
    odds = np.log((seen[1] + 0.3) / (y.sum() + 1)) - np.log((seen[0] + 0.3) / ((1 - y).sum() + 1))
    net.emb[:, 0] = np.where(seen.sum(axis=0) >= 3, np.clip(odds, 0, 4) / FEATURES, 0)
    net.taps[0, 0, 0], net.bias[0], net.out[0] = 1.0, -1.0, 2.0


def fit(docs: Sequence[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 11) -> Net:
    """Adagrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    net = fresh(rng)
    begun_at_odds(net, docs, y)
    grown = {k: np.full(np.shape(getattr(net, k)), 1e-2, np.float32) for k in ("emb", "taps", "bias", "out", "out_bias")}
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            found = gradients(net, docs, y, part)
            u = found["buckets"]
            grown["emb"][u] += found["emb"] * found["emb"]
            net.emb[u] -= rate * found["emb"] / np.sqrt(grown["emb"][u])
            for name in ("taps", "bias", "out", "out_bias"):
                grown[name] += found[name] * found[name]
                setattr(net, name, getattr(net, name) - rate * found[name] / np.sqrt(grown[name]))
    return net


def threshold(z: np.ndarray, y: np.ndarray, default: float = 0.0, least: int = 10, count: np.ndarray | None = None) -> float:
    """The logit that separates the classes with the highest F1, in the middle of the gap; default with few rows.

    `count` says how many rows each entry stands for, one if it isn't given.
    """
    count = np.ones(len(z)) if count is None else count
    toxic = (count * y).sum()
    if toxic < least or count.sum() - toxic < least:
        return default
    value, at = np.unique(-z, return_inverse=True)
    hits = np.cumsum(np.bincount(at, count * y))
    f1 = 2 * hits / (np.cumsum(np.bincount(at, count)) + toxic)
    best = int(f1.argmax())
    low = -value[best + 1] if best + 1 < len(value) else -value[best] - 1
    return float((low - value[best]) / 2)


def _languages(languages, texts: pa.Array) -> np.ndarray:
    return language_id.single_best(languages, texts) if languages.langs else np.zeros(len(texts), int)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's label and packed word features, of the whole text."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts, blobs = batch.column("text"), []
        for start, n in slices(texts):
            words, at = word_features(texts.slice(start, n))
            blobs += [pack.compress(words[at[i] : at[i + 1]].tobytes()) for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(blobs, pa.binary())], ["label", "words"])


def _logit_counts(rows: DataFrame, net: Net) -> pd.DataFrame:
    """label, lang, step and how many of the rows (label, text) have them; the executors score the rows."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            for start, n in slices(texts):
                piece = texts.slice(start, n)
                z = logits(m, *word_features(piece))
                step = np.rint(np.clip(z, -MOST, MOST) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(start, n), pa.array(_languages(m.languages, piece), pa.int32()), pa.array(step)], ["label", "lang", "step"])

    return rows.mapInArrow(tidied(run), "label int, lang int, step int").groupBy("label", "lang", "step").agg(F.count("*").alias("many")).toPandas()


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", lang_col: str = "lang", sample_per_class: int = 1500) -> Net | None:
    """Fit net and thresholds on the rows given; None without rows of both classes.

    A fifth of the labelled rows is held back and chooses the thresholds, all of it. The net is fitted on a bounded
    sample of the others' whole texts: `sample_per_class` documents of each class in expectation, before the held-back
    ones leave, picked by a hash of the id.
    """
    bounded_batches(docs.sparkSession)
    # names of our own, whatever else the tables have
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("__id").isNotNull())
    marks = marks.groupBy("__id").agg(F.max("label").cast("int").alias("label"))
    docs = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    part = lambda c: F.pmod(F.xxhash64(F.lit("part"), F.col(c).cast("string")), F.lit(5)) == 0
    sizes = marks.groupBy("label").agg(F.count("*").alias("__n"))
    picked = small_side(marks.join(sizes, "label").where(keep_share(F.lit(float(sample_per_class)) / F.col("__n"), "__id")).select("__id", "label"), "marks")
    texts = docs.where(F.col("text").isNotNull())
    rows = texts.join(picked, F.col("__doc") == F.col("__id")).select("label", part("__id").alias("held"), "text")
    rows = stored(rows.repartition(12), "toxic")
    languages = language_id.train(docs, "text", "lang", "__doc", sample_per_lang=1000)
    known = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if {label for _, label in known} != {0, 1}:
        return None
    used = rows.where("NOT held") if {(False, 0), (False, 1)} <= known else rows
    got = used.select("label", "text").mapInArrow(tidied(_encoded), "label int, words binary").toPandas()
    got = got.iloc[np.lexsort((pd.util.hash_array(got["words"].to_numpy()), got["label"]))]  # the same net however the rows arrive
    net = fit(Packed(got["words"].to_list()), got["label"].to_numpy(np.float32))
    net.languages = languages
    # the part is told from the documents' ids before the join, so that other texts are not moved
    held_marks = small_side(marks.where(part("__id")), "held")
    held = texts.where(part("__doc")).join(held_marks, F.col("__doc") == F.col("__id")).select("label", "text")
    counts = _logit_counts(held, net)
    if not len(counts):
        counts = _logit_counts(used.select("label", "text"), net)
    z, y, many, lang = counts["step"].to_numpy() / STEPS, counts["label"].to_numpy(), counts["many"].to_numpy(), counts["lang"].to_numpy()
    overall = threshold(z, y, count=many)
    net.shift = np.array([threshold(z[lang == k], y[lang == k], overall, count=many[lang == k]) for k in range(max(1, len(languages.langs)))])
    return net


def score(docs: DataFrame, net: Net | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, score (0 to 1) and predicted (1 from 0.5 on).

    Only the text goes to Python, and only the score comes back; all other columns stay where they are.
    """
    if net is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            out = np.zeros(len(texts))
            for start, n in slices(texts):
                piece = texts.slice(start, n)
                lang = language_id.single_best(m.languages, piece) if len(m.shift) > 1 else np.zeros(n, int)
                out[start : start + n] = 1 / (1 + np.exp(-np.clip(logits(m, *word_features(piece)) - m.shift[lang], -500, 500)))
            yield pa.StructArray.from_arrays([pa.array(out, pa.float64()), pa.array((out >= 0.5).astype(np.int32))], ["score", "predicted"])

    def judge_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(run)(batches)

    judge = F.arrow_udf(judge_all, "score double, predicted int").asNondeterministic()  # so that it runs once a row
    found = docs.select(*keep, judge(F.col(text_col).cast("string")).alias("__found"))
    return found.select(*keep, "__found.score", "__found.predicted")


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from rows that are not held out."""
    rest = remainder("doc_id", 5)
    net = train(docs.where(rest != 0), labels.where(rest != 0))
    return score(docs, net).select("doc_id", (rest == 0).alias("held_out"), "score", "predicted")
