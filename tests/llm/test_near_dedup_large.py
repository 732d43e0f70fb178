"""Hubs, large groups and recall where nodes branch."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import common, components, near_dedup
from flowlens.llm.common import table

from .test_results import components as brute


def test_join_heavy_keeps_all_rows(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5500")
    for how, rows in (("left", 6000), ("inner", 5999)):
        got = common.join_heavy(left, right, "k", "n", how)
        assert got.count() == rows and got.where("k = 1 and n = 5000").count() == 5000


@pytest.mark.parametrize("low", [True, False])
def test_components_with_a_hub(spark, low):
    hub = 0 if low else 10_000
    edges = [(hub, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(4000, 4020)] + [(4020, 2999), (5000, 5001), (5001, 5000), (6000, 6000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    first = 0 if low else 1
    assert got == {i: first for i in [hub, *range(1, 3000), *range(4000, 4021)]} | {5000: 5000, 5001: 5000}


def test_a_large_group_of_near_copies_and_its_strays(spark, monkeypatch):
    for name, value in (("GROUP_SIZE", 10), ("BLOCK_SIZE", 8), ("PIVOTS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), 1 + i % 4):
            w[k] = f"x{i}"
        texts[i] = " ".join(w)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(texts, 80)


def test_trees_follow_from_the_recall(spark, monkeypatch):
    assert near_dedup.trees(85, 0.9) < near_dedup.trees(85) <= near_dedup.trees(80) <= near_dedup.PATHS
    with pytest.raises(ValueError):
        near_dedup.trees(30)
    monkeypatch.setattr(near_dedup, "NODE_SIZE", 8)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    want = brute({r.doc_id: r.text for r in docs.collect()}, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=80).collect()}
    linked = [i for i, w in want.items() if w[1] != i]
    assert sum(got[i] == want[i][1] for i in linked) >= 0.99 * len(linked) and all(got[i] >= w[1] for i, w in want.items())
