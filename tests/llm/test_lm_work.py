"""The language model does its work once, with the results of doing it plainly."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from flowlens.llm import lm
from flowlens.llm.shingles import words_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_texts_are_split_as_bytes_are():
    rng = np.random.default_rng(3)
    texts = ["", " ", "\n\t", "a", " Ab  C\x0b\x0cd\r", "".join(map(chr, range(128))), " É x\x85\x1c　y "]
    texts += ["".join(rng.choice(list(" \t\n\x0b\x0c\r\x1c\x1f\x00aBÉ "), n)) for n in range(40)]
    flat, sizes = lm.split(pa.array(texts, pa.string()))
    assert [w.encode() for w in flat.to_pylist()] == [w for t in texts for w in [*words_of(t), b""]]
    assert sizes.tolist() == [len(words_of(t)) + 1 for t in texts]


def test_counts_have_each_word_and_end(monkeypatch):
    monkeypatch.setattr(lm, "COUNT_CHARS", 9)
    found = list(lm._count_words(iter([pa.RecordBatch.from_arrays([pa.array(["a B a", "b", "", "c a"])], ["text"])])))
    got = {h: n for b in found for h, n in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist())}
    assert got == dict(zip(lm._hashes([b"a", b"b", b"c", b""]).tolist(), (3, 2, 1, 4)))


def test_later_windows_attend_from_their_own_places_only(monkeypatch):
    spelling, plain, places = lm.spelling_of(PATH), lm.attend, []

    def attend(*args):
        out = plain(*args)
        places.append(out[1].shape[0] * out[1].shape[1])
        return out

    monkeypatch.setattr(lm, "attend", attend)
    model = lm.finished(lm.train([], spelling, PATH, steps=1), spelling)
    places.clear()
    n = lm.WINDOW + 4 * lm.STRIDE
    prob, _ = lm.score_ids(model, np.arange(n), np.array([0]), spelling.end)
    assert sum(places) == n and np.isfinite(prob).all()


def test_a_worker_reads_the_ids_once():
    assert lm.spelling_of(PATH) is lm.spelling_of(PATH)


def test_a_row_that_is_no_context_rests():
    """One step over 'a b' ends with the end as next id: only contexts move."""
    spelling = lm.spelling_of(PATH)
    start = lm.train([], spelling, PATH, steps=1)

    class Held:
        value = __import__("pickle").dumps(start)

    (out,) = lm._round(Held, 0.01)(iter([pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])]))
    uses = dict(zip(out.column("id").to_pylist(), out.column("n").to_pylist()))
    ids = [spelling.end, *spelling.ids(b"a"), *spelling.ids(b"b")]
    assert uses == {-1: len(ids), **{i: 1 for i in ids}}
