import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as tx


def test_finds_stems_in_new_forms(spark):
    """Toxic words are stems with endings; held-out documents have endings that training never saw."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    docs, labels = [], []
    for i in range(1500):
        words, toxic = [word() for _ in range(40)], i % 4 == 0
        if toxic:
            words[int(rng.integers(40))] = "zorgu" + "".join(rng.choice(list("klmnop"), 3))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tx.op4_toxicity(d, y).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert len(held) > 200 and np.mean([p == t for p, t in held]) >= 0.97


def test_labels_of_held_out_rows_are_not_read(docs, labels):
    from sparkloom.llm.common import remainder

    turned = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    pick = lambda y: sorted((r["doc_id"], round(r["score"], 6)) for r in tx.op4_toxicity(docs, y).collect())
    assert pick(labels) == pick(turned)


def test_odd_rows(odd_docs, no_docs, spark):
    marks = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (99, 1), (1, 1), (4, 0), (4, None)], "doc_id long, toxic int")
    rows = tx.op4_toxicity(odd_docs, marks).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert tx.op4_toxicity(no_docs, marks).count() == 0
    none = tx.op4_toxicity(odd_docs, marks.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}


def test_threshold_in_the_gap():
    z, y = np.array([-3.0, -2.0, 1.0, 3.0] * 10), np.array([0, 0, 1, 1] * 10)
    assert -2 < tx.threshold(z, y) < 1


def test_long_texts_train_and_calibrate(spark):
    """Only long texts are toxic; their toxic words stand anywhere, and long clean ones are to be left alone."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    docs, labels = [], []
    for i in range(500):
        words, toxic = [word() for _ in range(1800 if i % 2 else 40)], i % 4 == 1
        if toxic:
            words[int(rng.integers(len(words)))] = "zorgu" + "".join(rng.choice(list("klmnop"), 3))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert all(len(t) > 8000 for i, t, _ in docs if i % 2)
    got = {r["doc_id"]: r for r in tx.op4_toxicity(d, y).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) >= 0.95


def test_portions_change_no_net(monkeypatch):
    """Gradients summed over portions of a batch equal those of the whole batch, and texts are scored alone."""
    rng = np.random.default_rng(5)
    y = np.array([0, 1] * 20, np.float32)
    docs = [rng.integers(0, 1 << tx.BITS, (int(rng.integers(0, 30)), tx.FEATURES)).astype(np.int32) for _ in y]
    whole = tx.fit(docs, y, epochs=2)
    monkeypatch.setattr(tx, "AT_ONCE", 20)
    parts = tx.fit(docs, y, epochs=2)
    assert np.allclose(whole.emb, parts.emb, atol=1e-4) and np.allclose(whole.taps, parts.taps, atol=1e-4) and np.allclose(whole.out, parts.out, atol=1e-4)
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    alone = [tx.logits(whole, d, np.array([0, len(d)]))[0] for d in docs]
    assert np.allclose(tx.logits(whole, np.concatenate(docs), at), alone, atol=1e-5)


def test_threshold_of_counts():
    z, y, count = np.array([-3.0, -2.0, 1.0, 1.0, 3.0]), np.array([0, 0, 0, 1, 1]), np.array([40, 5, 2, 9, 20])
    assert tx.threshold(z, y, count=count) == tx.threshold(np.repeat(z, count), np.repeat(y, count)) == -0.5


def small_net(rng):
    """A net of few embeddings in double precision, and documents for it, an empty one too."""
    net = tx.fresh(rng, buckets=40)
    for name in ("emb", "taps", "bias", "out"):
        setattr(net, name, rng.normal(0, 0.5, np.shape(getattr(net, name))))
    net.out_bias = 0.3
    return net, [rng.integers(0, 40, (n, tx.FEATURES)).astype(np.int32) for n in (5, 1, 0, 12, 3)]


def plain_logit(net, words):
    """One document's logit by loops over windows, filters and taps, with PAD empty rows after the words."""
    rows = [sum(net.emb[k] for k in word) for word in words] + [np.zeros(tx.DIM)] * tx.PAD
    total, f = net.out_bias, 0
    for i, width in enumerate(tx.WIDTHS):
        for c in range(tx.FILTERS):
            shots = [sum(rows[s + j] @ net.taps[:, sum(tx.WIDTHS[:i]) + j, c] for j in range(width)) + net.bias[f] for s in range(len(words) + 1)]
            total += max(0.0, max(shots)) * net.out[f]
            f += 1
    return total


def test_forward_pass():
    net, docs = small_net(np.random.default_rng(6))
    at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    got = tx.logits(net, np.concatenate(docs), at)
    assert np.allclose(got, [plain_logit(net, d) for d in docs])


def test_gradients_are_the_loss_s_slopes():
    rng = np.random.default_rng(7)
    net, docs = small_net(rng)
    y, part = np.array([1.0, 0.0, 1.0, 0.0, 1.0]), np.arange(5)
    loss = lambda: np.mean([np.logaddexp(0, z) - t * z for z, t in zip((plain_logit(net, d) for d in docs), y, strict=True)])
    found = tx.gradients(net, docs, y, part)
    full = np.zeros_like(net.emb)
    full[found["buckets"]] = found["emb"]
    for name, slopes in (("emb", full), ("taps", found["taps"]), ("bias", found["bias"]), ("out", found["out"])):
        array = getattr(net, name)
        for at in rng.choice(array.size, min(60, array.size), replace=False):
            at = np.unravel_index(at, array.shape)
            kept, sides = array[at], []
            for step in (1e-6, -1e-6):
                array[at] = kept + step
                sides.append(loss())
            array[at] = kept
            assert abs((sides[0] - sides[1]) / 2e-6 - slopes[at]) < 1e-5
