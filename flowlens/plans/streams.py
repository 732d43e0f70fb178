"""Streaming queries, run to the end of their input and read back, so that SQL can be held against them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.tables import cut_lineage
from flowlens.operators import sketches as K
from flowlens.sources import model as S
from flowlens.streaming import metrics as M

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its input is used up, written to and read from the session's shared folder."""
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    cut_lineage(spark.range(0))  # makes sure of a shared folder
    root = spark.sparkContext.getCheckpointDir()
    out = f"{root}/{name}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return M.read_events(spark, f"{d}/events.parquet*", _SCHEMA)  # a pattern, as a stream's source can be a folder or files by pattern, not one file




def throughput_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, of the hours that the watermark has closed."""
    rows = drained(M.throughput(_events(spark, d), ["event_type"], "1 hour", "1 hour"))
    return rows.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n")


def timing_buffer_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = drained(M.timing_buffer(_events(spark, d), ["event_type"], "value", "1 day", "1 hour"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "bin", "n", "least", "most")


_BIN = f"CAST(ceil(ln(value) / {K.math.log(K.GAMMA)!r}) AS INTEGER)"


QUERIES = {
    # a window is final once the watermark, the last event less the delay, has passed its end
    "throughput_stream": (
        throughput_stream,
        """SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    ),
    "timing_buffer": (
        timing_buffer_stream,
        f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, {_BIN} AS bin, count(*) AS n, min(value) AS least, max(value) AS most FROM events
        WHERE value > 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE value > 0) - INTERVAL 1 HOUR GROUP BY 1, 2, 3""",
    ),
    "metrics_cache": (
        lambda s, d: M.latest_broadcast(S.events(s, d).select(F.col("queue").alias("namespace_id"), F.col("created_at").alias("at"), "payload"), S.as_of("2024-01-30 22:00:00"), "2 hours").withColumnRenamed("at", "last_at"),
        f"WITH {S.EVENTS_SQL} SELECT queue AS namespace_id, max(created_at) AS last_at, arg_max(payload, created_at) AS payload, max(created_at) >= TIMESTAMP '2024-01-30 20:00:00' AS fresh FROM ev GROUP BY 1",
    ),
}
