"""Merkle fixity audit of replicated WARC archives.

Each record of an archive file is hashed once, where it is read. Hashes are then
joined into trees over ordered byte ranges: a node covers the records that start
in one range of its file, ``fanout`` nodes make one of the next level, and the
file's top nodes make its root. Two replicas are compared by their roots; only
below nodes that differ are the next level's nodes compared, down to the records.

Ranges are cut by offset, not by rank, so that a file with most of the records
spreads over as many groups as it has ranges, and no group is longer than a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed

#: Bytes that a lowest node covers, nodes in one of the next level, levels below the root.
RANGE, FANOUT, LEVELS = 64 << 10, 16, 3
#: Files for records that have no id to be filed by.
STRAY_FILES = 1024


def warc_record(url: Column, body: Column) -> Column:
    """A response record: header lines, an empty line, the body and two line ends."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, per_file: int = 512, stored: Callable[[Column], Column] = lambda record: record) -> DataFrame:
    """(file_id, offset, length, digest, page_id): the pages' records, filed by page_id, end to end.

    A file holds the pages of ``per_file`` ids, in order; rows that repeat an id follow
    each other by hash. Pages without an id go to negative files, by hash. The
    payload is hashed where it is read and goes no further. ``stored`` gives what a
    replica holds in a record's place, as its digest shows.
    """
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"), F.xxhash64(record).alias("_order"), F.sha2(stored(record), 256).alias("digest"))
    stray = -1 - F.pmod(F.col("_order"), F.lit(STRAY_FILES))
    filed = rows.withColumn("file_id", F.coalesce(F.floor(F.col("page_id") / per_file), stray))
    before = Window.partitionBy("file_id").orderBy("page_id", "_order").rowsBetween(Window.unboundedPreceding, -1)
    return filed.select("file_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", "page_id")


def leaves(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(file_id, offset, length, digest) of records that carry their payload; a null one is empty."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return records.select(F.col("file_id").cast("long").alias("file_id"), F.col("offset").cast("long").alias("offset"), F.length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))


def _digest_of(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ","), 256)


def tree(leaf: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (file_id, node, hash) of each level from the lowest; the last are the roots, node 0.

    A lowest node hashes its records' offsets, lengths and digests in order of
    offset; the others hash their children's numbers and hashes.
    """
    at = lambda name: F.lpad(F.col(name).cast("string"), 20, "0")
    record = F.concat_ws(":", at("offset"), F.col("length").cast("string"), F.col("digest"))
    low = leaf.groupBy("file_id", F.floor(F.col("offset") / range_bytes).alias("node")).agg(_digest_of(record).alias("hash"))
    found = [low]
    for _ in range(levels - 1):
        child = F.concat_ws(":", at("node"), F.col("hash"))
        found.append(found[-1].groupBy("file_id", F.floor(F.col("node") / fanout).alias("_up")).agg(_digest_of(child).alias("hash")).withColumnRenamed("_up", "node"))
    root = found[-1].groupBy("file_id").agg(_digest_of(F.concat_ws(":", at("node"), F.col("hash"))).alias("hash"))
    return [*found, root.select("file_id", F.lit(0).cast("long").alias("node"), "hash")]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of one level that differ, or that only one replica has."""
    both = a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), ["file_id", "node"], "full")
    return both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(leaf_a: DataFrame, leaf_b: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """What differs between two replicas: a row for each file, and one for each bad record.

    Columns: file_id, offset (null in a file's row), length_a, length_b, hash_a, hash_b
    and status. A file's row has the roots and 'intact', 'damaged', 'missing' (not in
    b) or 'extra' (not in a); a record's row has the digests and 'corrupt',
    'missing' or 'extra'. Only records of ranges whose hashes differ are compared.

    Inputs have file_id, offset, length and digest; rows with a null file or offset
    name no place and are left to the caller. Records at one offset count as one,
    with their digests in order. Empty replicas differ from what is there; two empty
    ones give no rows. Other columns are ignored.
    """
    named = "file_id is not null and offset is not null"
    one, two = (checkpointed(x.where(named).select("file_id", F.col("offset").cast("long").alias("offset"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("digest", F.lit("")).alias("digest"))) for x in (leaf_a, leaf_b))
    trees = [tree(x, range_bytes, fanout, levels) for x in (one, two)]
    roots = checkpointed(trees[0][-1].withColumnRenamed("hash", "hash_a").join(trees[1][-1].withColumnRenamed("hash", "hash_b"), ["file_id", "node"], "full"))
    bad = roots.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("file_id")
    for level in reversed(range(levels)):
        on, below = (["file_id"], [t[level] for t in trees]) if level == levels - 1 else (["file_id", "_up"], [t[level].withColumn("_up", F.floor(F.col("node") / fanout)) for t in trees])
        a, b = (x.join(bad, on, "left_semi").select("file_id", "node", "hash") for x in below)
        bad = _differing(a, b).select("file_id", F.col("node").alias("_up"))
    bad = checkpointed(bad)

    def suspects(x: DataFrame, side: str) -> DataFrame:
        some = x.withColumn("_up", F.floor(F.col("offset") / range_bytes)).join(bad, ["file_id", "_up"], "left_semi")
        return some.groupBy("file_id", "offset").agg(F.max("length").alias(f"length_{side}"), F.array_join(F.array_sort(F.collect_list("digest")), ",").alias(f"hash_{side}"))

    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra")
    met = suspects(one, "a").join(suspects(two, "b"), ["file_id", "offset"], "full")
    wrong = met.where(~(F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))))
    columns = ["file_id", "offset", "length_a", "length_b", "hash_a", "hash_b"]
    none = F.lit(None).cast("long")
    files = roots.select("file_id", none.alias("offset"), none.alias("length_a"), none.alias("length_b"), "hash_a", "hash_b", status.when(F.col("hash_a") == F.col("hash_b"), "intact").otherwise("damaged").alias("status"))
    return files.unionByName(wrong.select(*columns, status.otherwise("corrupt").alias("status")))
