"""Every operator on rows that are null, empty, long, tied or repeated, and on empty tables."""

import pytest

from flowlens.llm import decontaminate, fixity, lm, mixing, near_dedup, packing, quality, simhash, token_counts, toxicity

from .conftest import PROSE


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (None, "lazy dog"), (2, ""), (3, None), (4, PROSE), (5, "two words")], "item_id long, text string")


def by_id(rows, doc_id):
    return [r for r in rows if r.doc_id == doc_id]


def test_token_counts(edge, empty):
    rows = token_counts.count_tokens(edge).collect()
    assert len(rows) == 13 and all((r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False) for i in (3, 4) for r in by_id(rows, i))
    assert len({(r.n_bytes, r.n_tokens) for r in by_id(rows, 2)}) == 2 and by_id(rows, 6)[0].over_limit
    assert token_counts.count_tokens(empty).collect() == []


def test_lm(edge, empty):
    rows = lm.score_texts(edge).collect()
    assert len(rows) == 13 and {r.n_tokens for i in (3, 4, 5) for r in by_id(rows, i)} == {1}
    assert len({r.train_tokens for r in rows}) == 1 and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert lm.score_texts(empty).collect() == []


def test_near_duplicates(edge, empty):
    rows = near_dedup.near_duplicates(edge).collect()
    assert len(rows) == 13
    assert {r.component_id for r in by_id(rows, 2)} == {1} and by_id(rows, 8)[0].component_id == 7
    assert all(r.component_id == i and r.kept and r.n_shingles == 0 for i in (3, 4, 5) for r in by_id(rows, i))
    assert all(r.component_id is None and r.kept for r in by_id(rows, None))
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 3, 4, 5, 6, 7, 9] and all(r._id == 99 and r._n == 98 for r in got)
    assert near_dedup.near_duplicates(empty).collect() == near_dedup.keep_one(empty).collect() == []


def test_simhash(edge, empty):
    rows = simhash.similar_texts(edge).collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2) and r.n_chars == len(PROSE)}) == 1
    assert {r.fingerprint for i in (3, 4, 5) for r in by_id(rows, i)} == {"0" * 16}
    assert all(r.near_next is None for r in by_id(rows, None)) and len(rows) == 13
    assert simhash.similar_texts(empty).collect() == []


def test_packing(edge, empty):
    rows = packing.pack(edge, size=64).collect()
    found = [d for r in rows for d in r.doc_ids]
    assert set(found) == {None, *range(1, 10)} and all(len(r.input_ids) == len(r.position_ids) == 64 and r.cu_seqlens[-1] == r.n_tokens for r in rows)
    assert sum(s == 0 for r in rows for s in r.token_starts) == 13 and len({r.pack_id for r in rows}) == len(rows)
    assert packing.pack(empty).collect() == []


def test_decontamination(edge, empty, items):
    rows = decontaminate.contamination(edge, items).collect()
    assert len(rows) == 13 and all(r.contaminated and r.item_ids == [1, 4] for r in by_id(rows, 1)) and by_id(rows, 7)[0].item_ids == [5]
    assert not any(r.contaminated or r.n_words for i in (3, 4, 5) for r in by_id(rows, i))
    assert sorted((r.doc_id or 0) for r in decontaminate.keep_clean(edge, items).collect()) == [0, 2, 3, 4, 5, 6, 9]
    assert decontaminate.contamination(empty, items).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(edge, items.limit(0)).collect())


def test_mixing(edge, empty):
    rows = mixing.mixture(edge).collect()
    assert len(rows) == 13 and not any(r.sampled for i in (3, 4) for r in by_id(rows, i)) and by_id(rows, 4)[0].source == mixing.MISSING
    kept = mixing.mix(edge, keep=1.0)
    assert kept.columns == edge.columns and all(r._tokens == 97 for r in kept.collect())
    assert mixing.mixture(empty).collect() == mixing.mix(empty).collect() == []


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers(edge, empty, labels, score):
    rows = score(edge, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in by_id(rows, 2) + by_id(rows, 1)}) == 2
    assert len({r.score for r in score(edge, labels.limit(0)).collect()}) == 1
    assert score(empty, labels).collect() == []


def test_harmless_rows_stay(edge, empty, labels):
    assert toxicity.keep_harmless(edge, labels.where("toxic = 0")).count() == 13
    assert toxicity.keep_harmless(empty, labels).collect() == []


def test_fixity(spark):
    pages = spark.createDataFrame([(1, "u", "a", 5), (1, "u", "a", 5), (2, None, None, 5), (None, "v", "b", 5), (600, "w", "", 5)], "page_id long, url string, html string, digest int")
    one = fixity.archive(pages)
    assert one.count() == 5 and {r.status for r in fixity.audit(one, one).collect()} == {"intact"}
    lost = fixity.audit(one, one.where("page_id is null or page_id <> 600")).collect()
    assert sorted(r.status for r in lost if r.offset is not None) == ["missing"]
    assert fixity.audit(one.limit(0), one.limit(0)).collect() == []
