"""The language model learns from all training texts, not only from those that its start is fitted on."""

import numpy as np
import public_tokenizers
import pytest

from flowlens.llm import lm
from flowlens.llm.common import fold


def test_ids_outside_the_start_are_learnt(spark, monkeypatch):
    for name in ("START_DOCS", "TRAIN_DOCS"):
        monkeypatch.setattr(lm, name, 1, raising=False)
    docs = spark.createDataFrame([(i, f"the harbour {'wall' if i % 2 else 'ship'} number {i}") for i in range(80)], "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model, spelling = lm.fit(docs, path), lm.Spelling(path)
    for word in (b"wall", b"ship"):
        (i,) = spelling.ids(word)
        assert model.table[i].max() > 0.01 and abs(model.rows[i]).max() > 0


def test_a_round_counts_every_id_once(spark):
    docs = spark.createDataFrame([(i, " ".join(["one two three"] * (i % 40))) for i in range(120)], "doc_id long, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    spelling = lm.Spelling(path)
    start, texts = lm.train([], spelling, path, steps=1), docs.where(fold("doc_id", 7) != 2)
    shares = start.table * 0.0
    lm.improved(start, texts.select("text"), shares, 0.01)
    for ids, n in ((spelling.ids(b"two"), sum(r.doc_id % 40 for r in texts.collect())), ([spelling.end], texts.count())):
        assert shares[ids].sum() == pytest.approx(n, rel=1e-4)


def test_scores_are_those_of_plain_attention(spark):
    """Windows, masks and mixture parts, one place at a time in Python; and no overflow on large weights."""
    rng = np.random.default_rng(6)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    spelling = lm.Spelling(path)
    parts, width = 24, 8
    for size in (1.0, 100.0):
        rows = (rng.normal(0, size, (spelling.size, 2 * width + 2 * parts))).astype(np.float32)
        table = rng.dirichlet(np.ones(50), parts).T.astype(np.float32)
        table = np.concatenate((table, np.full((spelling.size - 50, parts), 1e-6, np.float32)))
        model = lm.finished(lm.Start(rows, rng.normal(0, 1, lm.WINDOW).astype(np.float32), table, path), spelling)
        ids, docs = rng.integers(0, 50, 150), np.array([0, 5, 45])
        prob, border = lm.score_ids(model, ids, docs, spelling.end, rows=2)
        assert np.isfinite(prob).all() and np.isfinite(border).all()
        if size > 1:
            continue
        for lo, hi in ((0, 5), (5, 45), (45, 150)):
            context = np.concatenate(([spelling.end], ids[lo : hi - 1]))
            n, done, begin = hi - lo, 0, 0
            while done < n:
                begin = max(min(begin, n - lm.WINDOW), 0)
                for i in range(done, min(begin + lm.WINDOW, n)):
                    at = context[begin : i + 1]
                    score = rows[at, width : 2 * width] @ rows[at[-1], :width] / np.sqrt(width) + model.place[np.arange(len(at))[::-1]]
                    a = np.exp(score) / np.exp(score).sum()
                    u = np.exp(a @ rows[at, 2 * width : 2 * width + parts] + rows[at[-1], 2 * width + parts :])
                    assert np.isclose(prob[lo + i], np.log(u @ table[ids[lo + i]] / u.sum()), rtol=1e-3, atol=1e-4)
                done, begin = begin + lm.WINDOW, begin + lm.STRIDE


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(7)
    rows, place = rng.normal(0, 0.5, (2, lm.WINDOW, 2 * 4 + 2 * 3)).astype(np.float32), rng.normal(0, 0.5, lm.WINDOW).astype(np.float32)
    t = rng.uniform(0.1, 1, (2, lm.WINDOW, 3)).astype(np.float32)

    def loss(rows, place):
        _, u, _ = lm.attend(rows, lm._seen(place), 3)
        return -np.log((u * t).sum(-1) / u.sum(-1)).astype(np.float64).mean()

    g_rows, g_place, _ = lm.gradients(rows, place, t)
    for x, g in ((rows, g_rows), (place, g_place)):
        for _ in range(25):
            at, d = tuple(rng.integers(0, k) for k in x.shape), np.zeros_like(x)
            d[at] = 0.05
            up, down = (loss(rows + k * d, place) if x is rows else loss(rows, place + k * d) for k in (1, -1))
            assert np.isclose((up - down) / 0.1, g[at], rtol=0.05, atol=2e-4)


def test_words_are_spelled_as_one_by_one():
    spelling = lm.Spelling(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = [b"the", b"harbour", "é漢字".encode(), b"12345", b"don't", b"<|endoftext|>", b"x" * 3000, b"\x00\x01", b"a_b-c", "\u00a0a\u3000b".encode(), b"\x1cq"]
    for some in (words, words[:-2]):
        ids, lens = spelling.spell(some)
        assert [ids[a : a + n].tolist() for a, n in zip(np.cumsum(lens) - lens, lens)] == [spelling.ids(w) for w in some]


def test_frequent_words_have_a_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 30 + [5, 7, 2000, 2010, 90_000])], "hash long, n long")
    assert [lm.frequent(counts, k) for k in (0, 1, 3, 5, 34, 35, 1000)] == [(1 << 63) - 1, 90_000, 2000, 5, 5, 2, 1]


def test_rows_are_summed_by_id():
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 40, 300), np.arange(9), np.zeros(70, np.int64)):
        grad = rng.normal(0, 1, (len(ids), 5)).astype(np.float32)
        for size in (50, 1 << 17):
            held, sums = lm._scatter(ids, grad, size)
            assert held.tolist() == sorted(set(ids.tolist()))
            assert np.allclose(sums, [grad[ids == i].sum(0) for i in held], atol=1e-4)
