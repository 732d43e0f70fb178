"""Token-id output: best-fit-decreasing packing into fixed rows.

Documents become token ids with an end id behind each, and are cut into segments
of at most one row, so nothing is lost. Segments go, longest first, into the
open row with the least room that still fits; a segment tree over capacities
finds it in the logarithm of the row length. Each task packs what it reads, in
blocks of bounded size, so nothing is shuffled and a lost task is just run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch, text_of
from flowlens.llm.pieces import MOST_KEPT, Cutter

#: Tokens that a task gathers before it packs them; pieces in a worker's cache.
BLOCK_TOKENS, CACHE_SIZE = 4_000_000, 750_000


class Capacities:
    """Segment tree over the rooms 0..size left in open rows: how many rows have each."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.count = [0] * (2 * self.half)

    def add(self, room: int, n: int) -> None:
        at = room + self.half
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The least room >= need that some row has."""
        count, at = self.count, need + self.half
        if count[at]:
            return need
        while at > 1:  # up to the first right neighbour with rows, then down its left side
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.half
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Item numbers of each row, in the order that rows are opened; ties go by item number."""
    tree, rows, open_rows, room = Capacities(size), [], {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        at = tree.least(need)
        if at is None:
            row, at = len(rows), size
            rows.append([])
            room.append(size)
        else:
            row = open_rows[at].pop()
            tree.add(at, -1)
        rows[row].append(item)
        room[row] = at - need
        open_rows.setdefault(at - need, []).append(row)
        tree.add(at - need, 1)
    return rows


class Encoder:
    """Text to token ids, piece by piece, keeping the ids of pieces already seen."""

    def __init__(self, ranks_path: str, end: int, limit: int = CACHE_SIZE):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.uint16 if max(max(ranks.values()), end) < 1 << 16 else np.uint32
        self.cutter, self.limit, self.end = Cutter([]), limit, np.array([end], self.kind).tobytes()
        self.known: dict[str, bytes] = {}
        self.initial = np.zeros(max(ranks.values()) + 1, bool)  # ids of tokens that begin with a space
        self.initial[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of new keys. Words are encoded together: a space begins each one, and no other token of them."""
        words = [k for k in new if k and k[0] not in "\0\n"]
        found: dict[str, bytes] = {}
        if words:
            flat = self.encoding.encode_to_numpy(" " + " ".join(words), disallowed_special=())
            first = np.flatnonzero(self.initial[flat])
            if len(first) == len(words):
                raw, width = flat.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
                cuts = (np.append(first, len(flat)) * width).tolist()
                found = {k: raw[i:j] for k, i, j in zip(words, cuts, cuts[1:])}
        for k in new - found.keys():
            found[k] = np.array(self.encoding.encode_ordinary(Cutter.piece(k)), self.kind).tobytes()
        if len(self.known) + len(found) > self.limit:
            self.known.clear()
        self.known.update((k, v) for k, v in found.items() if len(k) <= MOST_KEPT)
        return found

    def encode(self, text: str) -> np.ndarray:
        keys, known = self.cutter.keys(text), self.known
        got = list(map(known.get, keys))
        if None in got:
            fresh = self._learn({k for k, v in zip(keys, got) if v is None})
            got = [fresh[k] if v is None else v for k, v in zip(keys, got)]
        return np.frombuffer(b"".join(got) + self.end, self.kind)


def _pack(ranks_path: str, size: int, end: int, pad: int):
    def rows_of(segments: list[tuple[int | None, int, np.ndarray]], number: int) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packed = best_fit_decreasing([len(s[2]) for s in segments], size)
        for at in range(0, len(packed), 512):
            some = packed[at : at + 512]
            ids = np.full((len(some), size), pad, np.int32)
            lens = np.array([len(segments[i][2]) for items in some for i in items], np.int64)
            per_row = np.array([len(items) for items in some])
            row = np.repeat(np.arange(len(some)), per_row)
            first = np.cumsum(per_row) - per_row
            ends = np.cumsum(lens) - np.repeat((np.cumsum(lens) - lens)[first], per_row)  # in the row
            filled = ends[first + per_row - 1]
            ids[np.arange(size) < filled[:, None]] = np.concatenate([segments[i][2] for items in some for i in items])
            # the place of each segment's start, and of the padding's, carried on to what comes before the next
            begin = np.zeros((len(some), size + 1), np.int32)
            begin[row, ends] = ends
            positions = np.arange(size, dtype=np.int32) - np.maximum.accumulate(begin[:, :size], axis=1)
            cuts = np.insert(ends, first, 0)
            docs = [segments[i][0] for items in some for i in items]
            starts = [segments[i][1] for items in some for i in items]
            bounds = pa.array(np.append(first, len(lens)).astype(np.int32))
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * size)
            yield batch(
                pack_id=pa.array((part << 33) + number + at + np.arange(len(some)), pa.int64()),
                n_tokens=pa.array(filled.astype(np.int32)),
                input_ids=pa.ListArray.from_arrays(offsets, pa.array(ids.reshape(-1))),
                position_ids=pa.ListArray.from_arrays(offsets, pa.array(positions.reshape(-1))),
                cu_seqlens=pa.ListArray.from_arrays(pa.array((np.append(first, len(lens)) + np.arange(len(some) + 1)).astype(np.int32)), pa.array(cuts.astype(np.int32))),
                doc_ids=pa.ListArray.from_arrays(bounds, pa.array(docs, pa.int64())),
                token_starts=pa.ListArray.from_arrays(bounds, pa.array(starts, pa.int64())),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, end)
        segments, held, number = [], 0, 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoder.encode(text)
                for at in range(0, len(ids), size):
                    segments.append((doc_id, at, ids[at : at + size]))
                    held += len(segments[-1][2])
                    if held >= BLOCK_TOKENS:
                        for out in rows_of(segments, number):
                            number += out.num_rows
                            yield out
                        segments, held = [], 0
        yield from rows_of(segments, number)

    return run


PACKED = "pack_id long, n_tokens int, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, doc_ids array<long>, token_starts array<long>"


def pack(docs: DataFrame, size: int = 2048, ranks_path: str | None = None, end: int = 50256, pad: int = 50256) -> DataFrame:
    """Packed rows of ``size`` token ids that together hold every token of ``docs``.

    ``input_ids`` has ``size`` ids, ``pad`` behind the first ``n_tokens``; segment k of
    a row is the stretch cu_seqlens[k] to cu_seqlens[k + 1], comes from document
    doc_ids[k] and starts with that document's token token_starts[k];
    ``position_ids`` start again at 0 with each segment and with the padding.
    Each document ends with ``end``. pack_id is unique, the task's number above bit 33.
    Which documents share a row, and pack_id, follow from how the table is partitioned:
    a task packs what it reads, in blocks of BLOCK_TOKENS.

    Null and empty texts are one ``end`` token; a document longer than a row is
    split into several segments; repeated rows are packed as often as they come, a
    null id stays null; special strings in a text are ordinary text; an empty table
    gives no rows; other columns are ignored.
    """
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_pack(ranks_path, size, end, pad), PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, tokens): the token ids that each document id has in ``packed``, in order.

    The inverse of ``pack`` where ids are not null and do not repeat.
    """
    piece = F.explode(F.arrays_zip("doc_ids", "token_starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"), F.sequence(F.lit(1), F.size("doc_ids"))))
    rows = packed.select("input_ids", piece.alias("s")).select(F.col("s.doc_ids").alias("doc_id"), F.col("s.token_starts").alias("at"), F.slice("input_ids", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("ids"))
    return rows.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("tokens"))
