import random

from sparkloom.llm import bpe
from sparkloom.llm import token_counts as tc


def plain(word, scores):
    """Best segmentation by trying all of them."""
    unknown = min(scores.values()) - 10
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] + 1)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best[end] = max(options, key=lambda o: (o[0], -o[1]))
    return best[len(word)][1]


def test_shared_prefixes():
    rng = random.Random(1)
    scores = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))): -rng.randint(1, 9) for _ in range(60)} | {b"a": -5, b"b": -5}
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    trie = tc.TrieCounter(scores)
    assert [trie.count(w) for w in words] == [plain(w, scores) for w in words]
    nodes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert trie.visited == len(nodes)  # each trie node once


def test_head_and_tail_agree(docs):
    scores = tc.zipf_scores(tc.pieces(tc.read_tokenizer(tc.default_vocabulary())))
    pick = lambda n: sorted(tuple(r) for r in tc.count_tokens(docs, scores, head_words=n).collect())
    assert pick(1 << 18) == pick(200)


def test_odd_rows(odd_docs, no_docs):
    rows = tc.op3_token_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    assert tc.op3_token_counts(no_docs).count() == 0


def test_whole_query_by_brute_force(spark):
    """Words by the tokenizer's own splitter, each one's best segmentation by trying all, over odd texts too."""
    from test_bpe import ODD
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tc.default_vocabulary())
    vocabulary = tc.pieces(tc.read_tokenizer(tc.default_vocabulary()))
    scores, back = tc.zipf_scores(vocabulary), {c: b for c, b in bpe.byte_alphabet().items()}
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["the cat " * 30, "=" * 200 + " " + "=" * 200, "Zw\u00f6lf Boxk\u00e4mpfer jagen Viktor quer \u00fcber den gro\u00dfen Sylter Deich"]
    expected, known = [], {}
    for i, text in enumerate(texts):
        words = []
        for k, segment in enumerate((text or "").split("<|endoftext|>")):
            words += [b"<|endoftext|>"] * (k > 0) + [bytes(back[c] for c in w) for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
        for w in words:
            if w not in known:
                known[w] = plain(w, scores)
        expected.append((i, len(words), sum(known[w] for w in words)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (1 << 18, 0):
        assert sorted(tuple(r) for r in tc.count_tokens(frame, scores, head_words=head).collect()) == expected


def test_frequent_long_words_are_in_the_head(spark):
    from sparkloom.llm.word_table import split_head

    table = spark.createDataFrame([("-" * 300, 90_000), ("a", 50_000_000), ("b" * 300, 1), ("c" * 2000, 90_000)], "word string, n long")
    head, outside = split_head(table)
    assert sorted(len(w) for w in head.table["word"].to_pylist()) == [1, 300] and sorted(len(r["word"]) for r in table.where(outside).collect()) == [300, 2000]
