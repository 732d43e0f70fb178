"""Helpers on whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the session's shared folder; one is made only where none is set and the session is local."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``; Spark prunes each partition to one row before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def ranked(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows under a total ``order``, numbered from 1 in ``pos``.

    The limit comes first, so that the numbering sees ``limit`` rows only.
    """
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def closure(edges: DataFrame, start: DataFrame, follow: Column | None = None, most: int = 1000, cut: bool = False) -> DataFrame:
    """All rows of ``edges`` (id, parent_id, ...) below the ids of ``start``, with their ``depth`` and ``root_id``.

    ``start`` has (root_id, id). Rows where ``follow`` is false are reached, but
    nothing below them is. What ``edges`` comes from is run once: the rows that have a
    parent are checkpointed (``cut`` tells that ``edges`` are already), and each level is one
    join on its ids only, cut off from its lineage. Ids must not be their own ancestors.
    """
    slim = edges.where("parent_id is not null").withColumn("_follow", F.lit(True) if follow is None else F.coalesce(follow, F.lit(False)))
    slim = slim if cut else cut_lineage(slim)
    front, found = start.select("root_id", F.col("id").alias("_p")), None
    for depth in range(1, most):
        level = cut_lineage(slim.join(front, slim["parent_id"] == front["_p"]).drop("_p").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return found if found is not None else level.drop("_follow")
        found = level.drop("_follow") if found is None else found.unionByName(level.drop("_follow"))
        front = level.where("_follow").select("root_id", F.col("id").alias("_p"))
    raise RuntimeError(f"more than {most} levels: is there a cycle?")
