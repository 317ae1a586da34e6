import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sparkloom.llm import language_id, toxicity
from sparkloom.llm.common import slices


def test_work_space_is_bounded(monkeypatch):
    """Judging 4 MB of texts takes a small part of an executor's memory, and the answers don't hang on the slices."""
    rng = random.Random(4)
    texts = pa.array([" ".join("".join(rng.choice("klmnopqr") for _ in range(6)) for _ in range(400)) for _ in range(1500)])
    net = toxicity.fresh(np.random.default_rng(1))
    model = language_id.LanguageModel(["a", "b", "c", "d"], np.random.default_rng(2).normal(-9, 1, (4, 1 << language_id.BITS)).astype(np.float32))

    def judged(*most):
        z = [toxicity.logits(net, *toxicity.word_features(texts.slice(i, n))) for i, n in slices(texts, *most)]
        return np.concatenate(z), language_id.single_best(model, texts)

    tracemalloc.start()
    z, lang = judged()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    whole, same = judged(1 << 22)
    assert np.allclose(z, whole, atol=1e-4) and (lang == same).all()


def test_stages_begin_with_heaps_that_are_returned(spark, no_docs, data):
    """What one stage made a heap grow to is given back by a full collection before the next one, else peaks add up."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, no_docs, data)
        assert full() > before, name
