"""The parts of positive-unlabelled learning against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import quality
from flowlens.llm.common import table


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    x_p, x_u = rng.normal(1, 1, (30, 5)), rng.normal(0, 1, (80, 5))
    params = [rng.normal(0, 0.5, (5, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 0.5, 4), np.array([0.2])]

    def risk(params):
        z = lambda x: np.tanh(x @ params[0] + params[1]) @ params[2] + params[3][0]
        plus, minus, all_ = np.logaddexp(0, -z(x_p)).mean(), np.logaddexp(0, z(x_p)).mean(), np.logaddexp(0, z(x_u)).mean()
        assert all_ - 0.4 * minus > 0
        return 0.4 * plus + all_ - 0.4 * minus

    grads = quality.risk_gradient(params, x_p, quality.risks(params, x_u, False), len(x_u), 0.4)
    for p, g in zip(params, grads):
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + 1e-5
            up = risk(params)
            p[at] = old - 1e-5
            down = risk(params)
            p[at] = old
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-6)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_a_planted_prior_is_found(prior):
    rng = np.random.default_rng(2)
    good, n = lambda k: rng.normal(1.5, 1, (k, 6)), 4000
    unlabelled = np.concatenate((good(int(n * prior)), rng.normal(-1.5, 1, (n - int(n * prior), 6))))
    rng.shuffle(unlabelled)
    assert quality.estimate_prior(good(1500), unlabelled, np.zeros(6), np.ones(6)) == pytest.approx(prior, abs=0.06)


def test_sums_cover_all_rows_and_bad_labels_are_not_read(spark, tiny):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    rows = quality.profile(docs)
    n = quality._summed(rows, lambda x: np.array([float(len(x)), x.sum()]))
    want = np.stack([quality.features(r.text) for r in docs.collect()])
    assert n[0] == len(want) and np.isclose(n[1], want.sum(), rtol=1e-4)
    one = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    two = {r.doc_id: r.score for r in quality.score_quality(docs, labels.where(F.col("quality") == 1)).collect()}
    assert all(np.isclose(one[k], two[k], atol=1e-6) for k in one)
