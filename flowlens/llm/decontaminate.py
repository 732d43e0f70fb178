"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers, each a text) and documents are normalised to
lower-case words with one space between them. Every run of ``width`` words of an
item is a pattern; one automaton over all of them is built once, broadcast, and
scans each document once. Patterns of more than ``AUTOMATON_CHARS`` characters
are cut into parts, each with an automaton that scans the documents in a round of
its own; a document's hits of all rounds are united before it is judged. Hits
are word numbers, which map back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from flowlens.llm.common import batch, checkpointed, map_batches, text_of

#: All ASCII but digits and letters parts words; A-Z are lower-cased; the bytes of other characters stay.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.ASCII)
_WORD_ANY_CASE = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Characters of the patterns of one automaton, at most (but one pattern at least); more are scanned in rounds of so much each.
AUTOMATON_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    """Lower-case words with single spaces between and around them; '' without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else ""


def windows(text: str | None, width: int) -> list[tuple[str, int]]:
    """(pattern, its words): each run of ``width`` words, or all of a shorter text."""
    words = normalised(text).split(" ")[1:-1]
    n = min(width, len(words))
    return [(f" {' '.join(words[i : i + n])} ", n) for i in range(len(words) - n + 1)] if n else []


def build_automata(items: Iterable[tuple[int | None, str | None]], width: int, most: int | None = None) -> Iterator[ahocorasick.Automaton]:
    """Automata of patterns to (words, item ids that have it), each of ``most`` characters of patterns; items without words or id have none.

    Only the patterns of one automaton are held at a time. A pattern that comes again
    in a later part is in both, with the items that have it there.
    """
    most = AUTOMATON_CHARS if most is None else most
    owners: dict[str, tuple[int, set[int]]] = {}
    size = 0

    def built() -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for pattern, (n, ids) in owners.items():
            automaton.add_word(pattern, (n, tuple(sorted(ids))))
        automaton.make_automaton()
        return automaton

    for item_id, text in items:
        if item_id is not None:
            for pattern, n in windows(text, width):
                if pattern not in owners:
                    if owners and size + len(pattern) > most:
                        yield built()
                        owners, size = {}, 0
                    size += len(pattern)
                owners.setdefault(pattern, (n, set()))[1].add(item_id)
    if owners:
        yield built()


def build_automaton(items: Iterable[tuple[int | None, str | None]], width: int) -> ahocorasick.Automaton | None:
    """One automaton of all patterns; none without any."""
    return next(build_automata(items, width, sys.maxsize), None)


def scan(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, the hit words as merged [first, after the last) runs, and the items found."""
    norm = normalised(text)
    n_words = norm.count(" ") - 1 if norm else 0
    found: set[int] = set()
    runs: list[tuple[int, int]] = []
    if automaton is None or not norm:
        return n_words, runs, found
    hits = list(automaton.iter(norm))
    if not hits:
        return n_words, runs, found
    spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    marked = np.zeros(n_words + 2, np.int64)
    for (_, (n, ids)), last in zip(hits, np.searchsorted(spaces, [end for end, _ in hits])):
        marked[last - n] += 1  # the pattern ends with the space after word ``last``
        marked[last] -= 1
        found.update(ids)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(marked) > 0, [0])).astype(np.int8)))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return n_words, runs, found


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of word numbers as [start, end) code point offsets in the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD_ANY_CASE.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def united(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The words of both lists of runs, as merged runs in order."""
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _pairs(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "end": e} for s, e in runs]


def _hits(batches: Iterator[pa.RecordBatch], model, at: int, width: int):
    """Each batch with, by row, n_words, runs and item ids, united with those of the rounds before in columns from ``width`` on."""
    automaton = pickle.loads(model.value)
    for b in batches:
        hits = [scan(text, automaton) for text in b.column(at).to_pylist()]
        if b.num_columns > width:
            before = zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist())
            hits = [(n, united([(r["start"], r["end"]) for r in runs], new), found.union(ids)) for (n, new, found), (runs, ids) in zip(hits, before)]
        yield b, hits


def _carry(model, at: int, width: int):
    """A round that isn't the last: the rows with their runs and item ids so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in _hits(batches, model, at, width):
            added = [pa.array([_pairs(r) for _, r, _ in hits], _PAIRS), pa.array([sorted(i) for *_, i in hits], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *added], [*b.schema.names[:width], _own("runs", b.schema.names[:width]), _own("items", b.schema.names[:width])])

    return run


def _own(name: str, columns: list[str]) -> str:
    """A column name that is longer than all others, so that it is none of them."""
    return "_" * max(map(len, columns)) + name


def _rounds(rows: DataFrame, items: DataFrame, width: int):
    """``rows`` after all rounds but the last, and the broadcast automaton of the last.

    Rounds are parted by a checkpoint, so that a worker holds one automaton at a time; rows aren't shuffled.
    """
    spark, names, at = rows.sparkSession, rows.columns, rows.columns.index("text")
    schema = StructType([*rows.schema.fields, StructField(_own("runs", names), ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))), StructField(_own("items", names), ArrayType(LongType()))])
    model = None
    for automaton in build_automata(item_texts(items), width):
        if model is not None:
            rows = checkpointed(rows.mapInArrow(_carry(model, at, len(names)), schema))
        model = spark.sparkContext.broadcast(pickle.dumps(automaton))
    return rows, model or spark.sparkContext.broadcast(pickle.dumps(None))


def _scanner(model, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in _hits(batches, model, 1, 2):
            rows = []
            for text, (n_words, runs, found) in zip(b.column(1).to_pylist(), hits):
                n_hit = sum(e - s for s, e in runs)
                rows.append((n_words, n_hit, sorted(found), n_hit > 0 and one_in * n_hit >= n_words, _pairs(spans(text, runs))))
            n, h, i, c, s = zip(*rows) if rows else ((),) * 5
            yield batch(
                doc_id=b.column(0),
                n_words=pa.array(n, pa.int64()),
                n_hit=pa.array(h, pa.int64()),
                item_ids=pa.array(i, pa.list_(pa.int64())),
                contaminated=pa.array(c, pa.bool_()),
                spans=pa.array(s, _PAIRS),
            )

    return run


def item_texts(items: DataFrame) -> Iterator[tuple[int | None, str | None]]:
    """The test items, one partition on the driver at a time."""
    return ((r.item_id, r.text) for r in items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).toLocalIterator())


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, contaminated and spans of every row of ``docs``.

    ``n_hit`` counts the document's words inside any occurrence of an item's
    window; a document is contaminated if they are at least one in
    ``one_in`` of its words, and one. ``spans`` are the hit stretches as code point offsets in the
    original text. Null and empty texts have no words and are clean; an item
    without words, or with a null id, matches nothing; items that share a window
    are all found; repeated rows give repeated rows; empty tables give clean or no
    rows; other columns are ignored.
    """
    rows, model = _rounds(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), items, width)
    return map_batches(rows, _scanner(model, one_in), "doc_id long, n_words long, n_hit long, item_ids array<long>, contaminated boolean, spans array<struct<start: long, end: long>>")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 13, one_in: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated (see ``contamination``)."""
    at, width_of_row = docs.columns.index("text"), len(docs.columns)
    rows, model = _rounds(docs, items, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hits in _hits(batches, model, at, width_of_row):
            clean = []
            for n_words, runs, _ in hits:
                n_hit = sum(e - s for s, e in runs)
                clean.append(n_hit == 0 or one_in * n_hit < n_words)
            yield b.select(range(width_of_row)).filter(pa.array(clean, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """``contamination``'s rows with the items as a count and a hash of their sorted ids."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def sha256_of_ids(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
