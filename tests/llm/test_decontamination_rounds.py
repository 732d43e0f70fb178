"""Decontamination in several rounds gives what one automaton gives."""

from flowlens.llm import decontaminate as D

ITEMS = [(1, "alpha beta gamma delta"), (2, "delta epsilon zeta eta"), (3, "one two three"), (None, "nine"), (4, "alpha beta gamma delta"), (5, "beta gamma delta epsilon")]
DOCS = [(1, "Alpha beta gamma delta epsilon zeta eta"), (1, "Alpha beta gamma delta epsilon zeta eta"), (2, "one two three " + "pad " * 30 + "delta epsilon zeta eta"), (3, None), (None, "beta gamma delta epsilon"), (4, "clean words only")]


def test_rounds_are_united_by_row(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 7) for r in DOCS], "doc_id long, text string, runs long").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    want = sorted(D.contamination(docs, items, width=4, one_in=6).collect(), key=str)
    kept = sorted(D.keep_clean(docs, items, width=4, one_in=6).collect(), key=str)
    assert [r.doc_id for r in want if r.contaminated].count(1) == 2 and any(r.contaminated and r.doc_id == 2 for r in want)
    for most in (1, 50):
        for name in ("AUTOMATON_CHARS", "AUTOMATON_BYTES"):
            monkeypatch.setattr(D, name, most, raising=False)
        assert sorted(D.contamination(docs, items, width=4, one_in=6).collect(), key=str) == want
        got = D.keep_clean(docs, items, width=4, one_in=6)
        assert got.columns == docs.columns and sorted(got.collect(), key=str) == kept
    assert len(list(D.build_automata(ITEMS, 4, 1))) > 3
