"""Fingerprints and near classes against plain Python, over whole tables."""

import hashlib
from collections import Counter, defaultdict

import xxhash

from flowlens.llm import queries, simhash
from flowlens.llm.common import table


def fingerprint(text):
    w = (text or "").lower().split(" ") if not (text or "").strip(" ") == "" else []
    w = [x for x in " ".join(w).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    total, sums = 0, [0] * 64
    for a, b in zip(w, [*w[1:], None]):
        weight = min(15, 1 + ((len(a) + len(b or "")) >> 2))
        h = xxhash.xxh64_intdigest(a.encode(), seed=42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), seed=h)
        total += weight
        for k in range(64):
            sums[k] += weight * (h >> k & 1)
    return sum(1 << k for k in range(64) if sums[k] * 2 > total)


def test_votes_and_near_classes(spark, tiny):
    texts = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    got = {r.doc_id: r for r in queries.op5_simhash(spark, tiny).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    order = sorted(texts, reverse=True)
    for i, after in list(zip(order, order[1:] + order[:1]))[:40]:
        t = texts[i] or ""
        k = len(t) // 3
        assert int(got[i].edited_fingerprint, 16) == fingerprint(t[: len(t) - k] + (texts[after] or "")[:k])
    classes, sizes = defaultdict(list), Counter(prints.values())
    for i, p in prints.items():
        classes[p].append(i)
    for i, r in got.items():
        near = [p for p in classes if (p ^ prints[i]).bit_count() <= 3]
        if i % 50:
            assert r.n_near is None and r.near_classes is None
        else:
            assert r.n_near == sum(sizes[p] for p in near) - 1 and r.near_classes == sorted(min(classes[p]) for p in near)


def test_repeated_rows_hot_texts_and_long_ones(spark):
    long = " ".join(f"w{i}" for i in range(5000))  # more than one stretch
    rows = [(i, "one hot text for all of them") for i in range(0, 300, 2)] + [(51, long), (51, long), (51, "other"), (None, "x y z"), (None, "x y z")]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.n_near for r in got if r.doc_id is not None and r.doc_id % 50 == 0} == {149}
    assert {int(r.fingerprint, 16) for r in got if r.n_chars == len(long)} == {fingerprint(long)}
    assert [r.edited_sha256 for r in got if r.doc_id is None] == [simhash_edit("x y ")] * 2


def simhash_edit(text):
    return hashlib.sha256(text.encode()).hexdigest()
