"""Whole results on the smallest tables, against SQL, brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import decontaminate, lm, mixing, near_dedup, packing, pieces, queries, simhash
from flowlens.llm.common import table

from ..oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def crc(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return table(spark, tiny, "documents").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, tiny, name):
    same(spark, connect(tiny), tiny, queries.queries()[name], queries.oracle_sql()[name])


def test_token_counts_are_the_librarys(spark, tiny, docs):
    tokenizer = pieces.load_tokenizer(pieces.tokenizer_path())
    want = {r.doc_id: (len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, tiny).collect()} == want


def test_lm_base_and_gain(spark, tiny, docs):
    count = Counter()
    for r in docs:
        if crc(r.doc_id, 7) != 2:
            count.update([*words(r.text), None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, tiny).collect()}
    assert len(got) == len(docs)
    for r in docs:
        tokens, g = [*words(r.text), None], got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (crc(r.doc_id, 7) == 2, len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert math.isclose(g.base_score, sum(math.log10((count[t] + 1) / (n + 1 * (v + 1))) for t in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    few = {r.doc_id: r for r in lm.score_texts(table(spark, tiny, "documents"), table_size=300).collect()}  # most counts are joined
    for k, r in got.items():
        assert r.n_known == few[k].n_known and math.isclose(r.base_score, few[k].base_score, rel_tol=1e-9) and math.isclose(r.score, few[k].score, rel_tol=1e-6)


def components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    x, y = sorted((find(i), find(j)))
                    top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark, tiny, docs):
    want = components({r.doc_id: r.text for r in docs}, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_dedup(spark, tiny).collect()} == want


def test_near_duplicates_with_branching_nodes_and_large_groups(spark, tiny, docs, monkeypatch):
    for name, value in (("NODE_SIZE", 3), ("GROUP_SIZE", 4), ("BLOCK_SIZE", 2), ("PIVOTS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    want = components({r.doc_id: r.text for r in docs}, 80)
    got = near_dedup.near_duplicates(table(spark, tiny, "documents"), percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want


def test_simhash_edits_and_likeness(spark, tiny, docs):
    text = {r.doc_id: r.text or "" for r in docs}
    order = sorted(text, reverse=True)
    got = {r.doc_id: r for r in queries.op5_simhash(spark, tiny).collect()}
    assert len(got) == len(text)
    for i, after in zip(order, order[1:] + order[:1]):
        t, k = text[i], len(text[i]) // 3
        edited = t[: len(t) - k] + text[after][:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        bits = lambda x: int(x, 16)
        assert math.isclose(got[i].near_next, 1 - (bits(got[i].fingerprint) ^ bits(got[after].fingerprint)).bit_count() / 64)
        assert math.isclose(got[i].near_edited, 1 - (bits(got[i].fingerprint) ^ bits(got[i].edited_fingerprint)).bit_count() / 64)
    same_text = {}
    assert all(same_text.setdefault(text[i], r.fingerprint) == r.fingerprint for i, r in got.items())
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1


def test_fingerprints_within_a_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    near = [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(62, 1 + i % 5, replace=False)))) for i, b in enumerate(base)]
    values = [int(b) for b in base] + near
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "fingerprint long")
    got = {(r["query"], r.fingerprint) for r in simhash.within(df, df, 3).collect()}
    assert got == {(a, b) for a in values for b in values if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_packing_round_trip(spark, tiny, docs):
    encoder = packing.Encoder(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256)
    packed = queries.op6_packing(spark, tiny)
    got = {r.doc_id: r.tokens for r in packing.unpack(packed).collect()}
    assert got == {r.doc_id: [*encoder.encoding.encode_ordinary(r.text or ""), 50256] for r in docs}
    rows = packed.collect()
    assert all(r.position_ids[a] == 0 for r in rows for a in r.cu_seqlens[:-1]) and all(x == 50256 for r in rows for x in r.input_ids[r.n_tokens :])


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(1, 21, 40).tolist()
        room, want = [], []
        for i in sorted(range(40), key=lambda i: (-lengths[i], i)):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(20 - lengths[i])
        want = sorted(20 - r for r in room)
        assert sorted(sum(lengths[i] for i in row) for row in packing.best_fit_decreasing(lengths, 20)) == want


def test_spans_lie_on_the_original_text():
    found = decontaminate.build_automaton([(1, "Alpha, beta! GAMMA")], 13)
    text = "é so: ALPHA -- beta gamma, and on"
    n, runs, ids = decontaminate.scan(text, found)
    assert (n, ids, [text[a:b] for a, b in decontaminate.spans(text, runs)]) == (7, {1}, ["ALPHA -- beta gamma"])


def test_raking(spark, tiny):
    rng = np.random.default_rng(3)
    tokens, a, b = rng.integers(1, 100, 30).astype(float), np.arange(30) % 5, np.arange(30) % 3
    ta, tb = np.full(5, 0.2), np.array([0.5, 0.3, 0.2])
    x = mixing.rake(tokens, [a, b], [ta, tb])
    assert np.allclose(np.bincount(a, x), ta, atol=1e-6) and np.allclose(np.bincount(b, x), tb, atol=1e-6)
    docs = table(spark, tiny, "documents")
    on_driver = {(r.source, r.lang, r.topic): r.weight for r in mixing.cell_weights(docs, sweeps=4).collect()}
    as_table = {(r.source, r.lang, r.topic): r.weight for r in mixing.cell_weights(docs, sweeps=4, driver_cells=0).collect()}
    assert on_driver.keys() == as_table.keys() and all(math.isclose(w, as_table[k], rel_tol=1e-6, abs_tol=1e-9) for k, w in on_driver.items())


def test_mixture_draws_by_probability(spark, tiny):
    rows = queries.op8_mixing(spark, tiny).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert math.isclose(expected, 0.8 * sum(r.n_tokens for r in rows), rel_tol=1e-3)
    assert all(r.sampled for r in rows if r.n_tokens and r.probability == 1.0)


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.mark.parametrize(("name", "label"), [("op9_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_labels(spark, name, label):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.queries()[name](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).collect()
    assert auc([r.score for r in rows], [r[label] for r in rows]) > 0.9
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.85


def test_pipeline_stage_by_stage(spark, tiny, tmp_path):
    now, seen = table(spark, tiny, "documents"), []
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, tiny).write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns and now.exceptAll(before).isEmpty()
        seen.append(before.collect())
    toxic, near, clean, mixed, packed = seen
    least = {min(i for i, x in want.items() if x[1] == c) for want in [components({r.doc_id: r.text for r in near}, 80)] for c in {x[1] for x in want.values()}}
    assert {r.doc_id for r in clean} == least
    found = {r.doc_id for r in decontaminate.contamination(spark.createDataFrame(clean), table(spark, tiny, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in clean} - {r.doc_id for r in mixed} == found
    assert {d for r in now.collect() for d in r.doc_ids} == {r.doc_id for r in packed} and 0 < len(packed) < len(toxic)
