"""Packed rows come back from their files as they were."""

import numpy as np
import pytest

from flowlens.llm import packed_files, packing

COLUMNS = ["pack_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_round_trip(spark, tmp_path):
    texts = [None, "", "one", *(" ".join(f"word{i * j % 97}" for j in range(i * 7 % 300)) for i in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, size=64).repartition(2, "n_tokens")  # ids in no order
    folder = (tmp_path / "out").as_uri()
    manifest = packed_files.write(packed, folder, size=64, file_rows=10)  # several files a task
    files = manifest.collect()
    want = _rows(packed)
    assert len(files) > 3 and max(r.n_rows for r in files) == 10 and sum(r.n_rows for r in files) == len(want)
    assert sum(r.n_tokens for r in files) == sum(r[1] for r in want)
    assert _rows(packed_files.read(manifest, folder)) == want
    ids, positions, lengths, bounds, _ = packed_files.sections(folder, *(files[0][c] for c in ("file", "n_rows", "size", "n_lengths")))
    assert ids.shape == positions.shape == (files[0].n_rows, 64) and bounds[-1] == len(lengths)
    for k in range(files[0].n_rows):  # positions start again at each segment
        cuts = lengths[bounds[k] : bounds[k + 1]]
        for a, b in zip(cuts, cuts[1:]):
            assert positions[k, a:b].tolist() == np.arange(b - a).tolist()
    with pytest.raises(ValueError):
        packed_files.sections(folder, files[0].file, files[0].n_rows + 1, 64, files[0].n_lengths)


def test_empty_table_and_repeated_write(spark, tmp_path):
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    folder = (tmp_path / "none").as_uri()
    manifest = packed_files.write(empty, folder)
    assert manifest.collect() == [] and packed_files.read(manifest, folder).collect() == []
    with pytest.raises(Exception, match="exist"):
        packed_files.write(empty, folder)
