import numpy as np
import pyarrow as pa

from sparkloom.llm import language_id as li


def test_held_out_accuracy(docs):
    rows = li.op1_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 30
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(docs):
    from pyspark.sql import functions as F

    from sparkloom.llm.common import remainder

    turned = docs.withColumn("lang", F.when(remainder("doc_id", 3) == 1, "zz").otherwise(F.col("lang")))
    pick = lambda d: sorted((r["doc_id"], r["lang_pred"]) for r in li.op1_language_id(d).collect())
    assert pick(turned) == pick(docs)


def test_mixtures():
    """Words of two languages in equal parts give both; a few foreign words don't pay for a second language."""
    rng = np.random.default_rng(0)
    own, other = rng.normal(-2, 0.1, 400), rng.normal(-8, 0.1, 400)
    half = np.stack([np.concatenate([own[:200], other[:200]]), np.concatenate([other[200:], own[200:]])])
    pure = np.stack([own, other])
    scores = np.concatenate([half, pure], axis=1).astype(np.float32)
    pi = li.mixtures(scores, np.array([0, 400, 800, 800]))
    assert abs(pi[0, 0] - 0.5) < 0.05 and pi[0, 1] == 1 and pi[1, 1] == 0 and pi[:, 2].sum() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = li.op1_language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert texts[2] == texts[3] == texts[4] == "und" and texts[1] != "und"
    assert li.op1_language_id(no_docs).count() == 0


def test_no_labels(docs):
    from pyspark.sql import functions as F

    rows = li.op1_language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_repair_of_bytes():
    h, word_at, text_at = li.grams(pa.array(["Été à Paris", None, "", "日本"]))
    assert list(text_at) == [0, 3, 3, 3, 4] and len(h) == len("été".encode()) + len("à".encode()) + 5 + 6 and len(word_at) == 4


def plain_em(like, pi, rounds=12):
    """One document: (proportions, log-likelihood less the words' maxima), word by word."""
    for _ in range(rounds):
        shares = [[p * x for p, x in zip(pi, word, strict=True)] for word in like]
        new = [sum(s[k] / max(sum(s), 1e-30) for s in shares) / len(like) for k in range(len(pi))]
        moved, pi = max(abs(a - b) for a, b in zip(new, pi, strict=True)), new
        if moved < 2e-3:
            break
    return pi, sum(np.log(max(sum(p * x for p, x in zip(pi, word, strict=True)), 1e-30)) for word in like)


def plain_mixture(scores, penalty=1.0):
    """One document's proportions: languages join in order of their share while the penalised likelihood gains."""
    k, top = len(scores), scores.max(axis=0)
    like = np.exp(scores - top).T.tolist()
    alone = (scores - top).sum(axis=1)
    chosen, value = np.eye(k)[alone.argmax()], alone.max()
    start, _ = plain_em(like, [1 / k] * k)
    order = np.argsort(-np.array(start), kind="stable")
    for size in range(2, k + 1):
        pi = np.array([max(start[i], 1e-6) if i in order[:size] else 0.0 for i in range(k)])
        got, gain = plain_em(like, (pi / pi.sum()).tolist())
        if not gain - value > 0.5 * penalty * np.log(len(like) + 1):
            break
        chosen, value = np.array(got), gain
    return chosen


def test_mixtures_by_brute_force():
    """Documents of one to three of five languages, and short ones: the same proportions and sets as a plain search,
    together and alone."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        n, own = int(rng.integers(1, 120)), rng.choice(5, int(rng.integers(1, 4)), replace=False)
        scores = rng.normal(-9, 1.5, (5, n))
        scores[rng.choice(own, n), np.arange(n)] += rng.uniform(1, 6)
        texts.append(scores.astype(np.float32))
    at = np.concatenate(([0], np.cumsum([t.shape[1] for t in texts])))
    got = li.mixtures(np.concatenate(texts, axis=1), at)
    assert (got > 0).sum(axis=0).max() >= 3
    for i, t in enumerate(texts):
        want = plain_mixture(t.astype(float))
        assert np.abs(got[:, i] - want).max() < 5e-3
        assert np.array_equal(li.mixtures(t, np.array([0, t.shape[1]]))[:, 0], got[:, i])


def test_bounds_of_the_sample(spark):
    """Rows without an id and copies don't swamp the sample; only the commonest labels are learned."""
    rows = [(None, f"the quick brown fox number {i % 40} jumps", "en") for i in range(4000)] + [(i, "der schnelle braune Fuchs " * 3 + str(i), "de") for i in range(300)] + [(10_000 + i, f"mot {i} rare", f"x{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(frame, sample_per_lang=100, most_langs=2)
    assert model.langs == ["de", "en"]
