import os
import pickle

import numpy as np

from flowlens.llm import toxicity


def test_model_is_fitted_by_a_task_on_the_same_rows(spark, monkeypatch):
    texts = {i: f"word{i % 7} {'nasty brute' if i % 3 == 0 else 'kind soul'} end" for i in range(40)}
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, other int").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    with monkeypatch.context() as m:
        m.setattr(toxicity, "fit", elsewhere)
        got = pickle.loads(toxicity.train(docs, labels))
    rows, weight = toxicity.training_rows(docs, labels)
    seen = sorted((r.doc_id, r.text, r.y) for r in rows.collect())
    want = fit([t for _, t, _ in seen], [y for _, _, y in seen], weight)
    assert 0 < len(seen) < 40 and np.array_equal(got.vectors, want.vectors) and got.bias == want.bias
    none = pickle.loads(toxicity.train(docs.limit(0), labels))
    assert none.constant
