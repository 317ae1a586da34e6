"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

The model gives every vocabulary piece a log-probability. A pre-token's best segmentation is found by forward scores:
the best score and token count of each of its prefixes. The distinct pre-tokens, in byte order, are the depth-first
walk of their trie: going from one to the next, the forward scores of the shared prefix stay as they are, and only
the new tail is computed, so each trie node is visited once. Terminal nodes store their word's count.

Defined cases: null and empty texts have no tokens; bytes that no piece covers count as one token each, by the byte
pieces; ties in score go to fewer tokens; a text is counted whole; repeated rows and null ids are allowed, since rows
are keyed in the one table written for the purpose; an empty table gives an empty result; columns of any other name and
type are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary, pieces, read_tokenizer
from .common import bounded_batches, heap_returned, stored_by_workers, tidied
from .word_table import Head, distinct_words, partitions_for, split_head, split_words


def zipf_scores(vocabulary: list[bytes]) -> dict[bytes, float]:
    """Log-probabilities by rank: a byte-pair vocabulary lists its pieces from the most to the least frequent."""
    total = log(sum(1 / (r + 1) for r in range(len(vocabulary))))
    out: dict[bytes, float] = {}
    for r, piece in enumerate(vocabulary):
        if piece:
            out.setdefault(piece, -log(r + 1) - total)
    return out


class TrieCounter:
    """Forward scores along the path to the last word; `count` reuses what the next word shares with it."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.word, self.best, self.tokens, self.visited = b"", [0.0], [0], 0

    def count(self, word: bytes) -> int:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        best, tokens, get = self.best, self.tokens, self.scores.get
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = best[end - 1] + self.unknown, tokens[end - 1] + 1
            for start in range(max(0, end - self.longest), end):
                score = get(word[start:end])
                if score is not None:
                    value = best[start] + score
                    if value > top or value == top and tokens[start] + 1 < n:
                        top, n = value, tokens[start] + 1
            best.append(top)
            tokens.append(n)
            self.visited += 1
        self.word = word
        return tokens[-1]


def count_words(words: DataFrame, scores: dict[bytes, float], parts: int) -> DataFrame:
    """(word, n, tokens), stored: words meet in byte ranges, sorted, so that shared prefixes are neighbours."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieCounter(shared.value)
        for batch in batches:
            counts = [trie.count(w.encode()) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(counts, pa.int64())], ["word", "n", "tokens"])

    return stored_by_workers(words.repartitionByRange(parts, "word").sortWithinPartitions("word"), tidied(run), "word string, n long, tokens long", "counts")


def count_tokens(docs: DataFrame, scores: dict[bytes, float], text_col: str = "text", id_col: str = "doc_id", head_words: int = 1 << 18) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""
    bounded_batches(docs.sparkSession)
    words = distinct_words(docs, text_col)
    heap_returned(docs.sparkSession)  # splitting texts makes heaps grow
    table = count_words(words, scores, partitions_for(words.count(), 200_000))
    head, outside = split_head(table, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(head.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(shared.value)
        tokens = np.append(np.asarray(head.table["tokens"]), 0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten().dictionary_encode()
            codes, known = np.asarray(flat.indices).astype(np.int64), head.places(flat.dictionary)
            at = np.concatenate(([0], np.cumsum(np.diff(np.asarray(lists.offsets)))))
            total = np.concatenate(([0], np.cumsum(tokens[known][codes] if len(codes) else np.zeros(0, np.int64))))
            other = np.flatnonzero(known[codes] < 0) if len(codes) else np.zeros(0, np.int64)
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, at), pa.int32()), flat.dictionary.take(pa.array(codes[other])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), rest, pa.array(np.arange(row, row + batch.num_rows))], ["doc_id", "n_pretokens", "known", "others", "row"])
            row += batch.num_rows

    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(F.col(text_col)).alias("words"))
    rows = stored_by_workers(split, tidied(run), "doc_id long, n_pretokens long, known long, others array<string>, row long", "places")
    heap_returned(docs.sparkSession)
    others = rows.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = others.join(table.where(outside).select("word", "tokens"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("rest"))
    out = rows.select("doc_id", "n_pretokens", "known", "row").join(found, "row", "left")
    return out.select("doc_id", "n_pretokens", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op3_token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document, under the byte-level vocabulary's pieces."""
    return count_tokens(docs, zipf_scores(pieces(read_tokenizer(vocabulary or default_vocabulary()))))
