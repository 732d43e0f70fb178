"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, without its lineage.

    The folder is the session's ``spark.checkpoint.dir``; one is made only where
    none is set and the session is local, as in tests.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def text_of(column: str = "text") -> Column:
    """A text column as string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of an id's decimal text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def join_heavy(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "left", most: int = 2000) -> DataFrame:
    """``left`` joined to ``right``, one row a key, on a key that may hold most of ``left``'s rows.

    ``n`` counts the rows of ``left`` for each key of ``right``. Keys with more than
    1 / ``most`` of all rows are fewer than ``most``: they are broadcast, so that their
    rows stay where they are. The others are shuffled.
    """
    size = right.agg(F.sum(n).alias("rows"), F.max(n).alias("largest")).first()
    limit = max((size.rows or 0) // most, 100)
    if (size.largest or 0) <= limit:
        return left.join(right, key, how)
    heavy, light = right.where(F.col(n) > limit), right.where(F.col(n) <= limit)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return left.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))
