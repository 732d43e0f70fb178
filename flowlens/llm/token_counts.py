"""Token counts by a map-side two-tier lookup.

The first tier is a compact table of the token lengths of the pieces that are
frequent in some part of the corpus; it is broadcast, and its size is bounded by
a parameter. The second is a cache in each Python worker: pieces that miss the
first tier are encoded once, in batches, by the tokenizer library itself. No
piece is ever shuffled; only each partition's few frequent ones are, to be added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, map_batches, text_of
from flowlens.llm.pieces import MOST_KEPT, Cutter, load_tokenizer, special_strings, tokenizer_path

#: A piece is frequent in a partition if it is at least one in so many of its pieces.
FREQUENT_SHARE = 20_000
#: Entries of the broadcast table, at most.
TABLE_SIZE = 32_768
#: Pieces that a worker's cache, or a partition's counter, holds at most.
CACHE_SIZE = 750_000


def _count_frequent(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(special_strings(load_tokenizer(path)))
        seen: Counter = Counter()
        total = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                keys = cutter.keys(text)
                total += len(keys)
                seen.update(keys)
                if len(seen) > CACHE_SIZE:  # what is rare so far can't be frequent in the partition by much
                    least = 1
                    while len(seen) > CACHE_SIZE // 2:
                        seen = Counter({k: n for k, n in seen.items() if n > least})
                        least *= 2
        top = [(k, n) for k, n in seen.items() if n >= max(2, total // FREQUENT_SHARE) and len(k) < 200]
        yield batch(key=pa.array([k for k, _ in top], pa.string()), n=pa.array([n for _, n in top], pa.int64()))

    return run


def frequent_lengths(docs: DataFrame, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """Token lengths of the ``size`` most frequent pieces of the whole corpus.

    Every text of ``docs`` is counted. Each partition passes on the pieces that
    make up at least 1 in FREQUENT_SHARE of its own, at most FREQUENT_SHARE of
    them. The table only saves work: counts don't depend on what is in it.
    """
    counts = map_batches(docs.select(text_of()), _count_frequent(path), "key string, n long")
    top = counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size)
    keys = [r["key"] for r in top.collect()]  # at most ``size`` rows
    tokenizer = load_tokenizer(path)
    encoded = tokenizer.encode_batch_fast([Cutter.piece(k) for k in keys], add_special_tokens=False)
    return {k: len(e) for k, e in zip(keys, encoded)}


class LengthCache:
    """The second tier: lengths of pieces, encoded in batches where they are new."""

    def __init__(self, path: str, table: dict[str, int], limit: int = CACHE_SIZE):
        self.tokenizer = load_tokenizer(path)
        self.cutter = Cutter(special_strings(self.tokenizer))
        self.table, self.limit = table, limit
        self.lengths = dict(table)

    def _encode(self, new: set[str]) -> None:
        todo = list(new)
        if len(self.lengths) + len(todo) > self.limit + len(self.table):
            self.lengths = dict(self.table)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            for key, e in zip(part, self.tokenizer.encode_batch_fast([Cutter.piece(k) for k in part], add_special_tokens=False)):
                self.lengths[key] = len(e)

    def count(self, text: str) -> int:
        keys = self.cutter.keys(text)
        try:
            return sum(map(self.lengths.__getitem__, keys))
        except KeyError:
            new = set(keys)
            self._encode({k for k in new if k not in self.lengths})
            if any(k not in self.lengths for k in new):  # the cache was emptied: this text alone
                self._encode({k for k in new if k not in self.lengths})
            total = sum(map(self.lengths.__getitem__, keys))
            for k in new:
                if len(k) > MOST_KEPT:
                    del self.lengths[k]
            return total


def _count_tokens(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = LengthCache(path, table.value)
        for b in batches:
            texts = b.column(1)
            n = [cache.count(t) for t in texts.to_pylist()]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()]
            yield batch(doc_id=b.column(0), n_bytes=pa.array(size, pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    return run


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    Counts are those of the tokenizer in ``path``, without begin, end or added
    special tokens; special strings inside a text count as the library's default
    has them. One row for each input row: repeated rows give repeated rows, a null
    id stays null, a null text counts as empty (0 bytes, 0 tokens), an empty table
    gives an empty result, and other columns are ignored, whatever their names.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size))
    return map_batches(rows, _count_tokens(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
