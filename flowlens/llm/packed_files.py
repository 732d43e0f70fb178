"""Packed rows as binary files that a trainer maps into memory, and back.

A file is one task's: for each of its rows, in order, the id matrix, the position
resets and the cumulative segment lengths, each kind in a section of its own, as
little-endian integers of 32 bits (``packs``: 64), so that a reader maps a section as an array:

- ``ids``: rows x size
- ``positions``: rows x size
- ``lengths``: the rows' ``cu_seqlens`` end to end; ``bounds`` (rows + 1) cuts them
- ``packs``: the rows' ``pack_id``

Tasks write below names of their own, one for each attempt, and the manifest lists the files of
those attempts that Spark took. A lost or repeated attempt leaves a file that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import batch

MANIFEST = "file string, n_rows long, size int, n_lengths long, n_tokens long"
PACKED = "pack_id long, n_tokens int, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>"

#: Rows in a file, at most; a task that has more begins another one. It holds those of one file.
FILE_ROWS = 4_096


def _bytes(x) -> bytes:
    return np.ascontiguousarray(x, "<i4").tobytes()


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _write(folder: str, size: int, file_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.bin"
            per_row = np.concatenate([b.column(4).value_lengths().to_numpy() for b in held])
            bounds = np.append(0, np.cumsum(per_row))
            with target.open_output_stream(f"{base}/{name}") as f:
                for i in (2, 3, 4):
                    for b in held:
                        f.write(_bytes(_flat(b.column(i))))
                f.write(_bytes(bounds))
                for b in held:
                    f.write(b.column(0).to_numpy().astype("<i8").tobytes())
            tokens = sum(int(b.column(1).to_numpy().sum()) for b in held)
            return batch(file=pa.array([name]), n_rows=pa.array([rows], pa.int64()), size=pa.array([size], pa.int32()), n_lengths=pa.array([int(bounds[-1])], pa.int64()), n_tokens=pa.array([tokens], pa.int64()))

        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, file_rows - rows)
                held.append(some)
                rows += some.num_rows
                at += some.num_rows
                if rows == file_rows:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    return run


def write(packed: DataFrame, folder: str, size: int = 2048, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes ``packed`` (of ``packing.pack`` with the same ``size``) to files in ``folder``; the manifest, a row a file.

    ``folder`` is a URI that the driver and all executors reach. The manifest is written to
    ``folder``/manifest.parquet, and what is returned is read from there. An empty table has an
    empty manifest. An earlier manifest there is an error, as Spark's writers have it.
    """
    target, base = fs.FileSystem.from_uri(folder)
    target.create_dir(base, recursive=True)
    rows = packed.select("pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens")
    rows.mapInArrow(_write(folder, size, file_rows), MANIFEST).write.parquet(f"{folder}/manifest.parquet")
    return packed.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")


def sections(folder: str, file: str, n_rows: int, size: int, n_lengths: int) -> tuple[np.ndarray, ...]:
    """ids, positions (rows x size), lengths, bounds and packs of a file that a manifest row describes."""
    source, base = fs.FileSystem.from_uri(folder)
    with source.open_input_file(f"{base}/{file}") as f:
        flat = np.frombuffer(f.read(), "<i4")
    cells = n_rows * size
    if len(flat) != 2 * cells + n_lengths + 3 * n_rows + 1:
        raise ValueError(f"{file} doesn't have the size that its manifest row says")
    ids, positions, lengths, bounds, packs = np.split(flat, np.cumsum([cells, cells, n_lengths, n_rows + 1]))
    return ids.reshape(n_rows, size), positions.reshape(n_rows, size), lengths, bounds, np.frombuffer(packs.tobytes(), "<i8")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, positions, lengths, bounds, packs = sections(folder, r["file"], r["n_rows"], r["size"], r["n_lengths"])
                for at in range(0, r["n_rows"], 512):
                    stop = min(at + 512, r["n_rows"])
                    cuts, edges = lengths[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at]
                    whole = pa.array(np.arange(stop - at + 1, dtype=np.int32) * r["size"])
                    yield batch(
                        pack_id=pa.array(packs[at:stop], pa.int64()),
                        n_tokens=pa.array(cuts[edges[1:] - 1], pa.int32()),
                        input_ids=pa.ListArray.from_arrays(whole, pa.array(ids[at:stop].reshape(-1), pa.int32())),
                        position_ids=pa.ListArray.from_arrays(whole, pa.array(positions[at:stop].reshape(-1), pa.int32())),
                        cu_seqlens=pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(cuts, pa.int32())),
                    )

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The rows of the files that ``manifest`` lists."""
    return manifest.repartition(F.col("file")).mapInArrow(_read(folder), PACKED)
