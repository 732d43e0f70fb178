"""Metrics over streams: sketches by tumbling window, smoothed rates, and waits that events wake.

Each function takes a streaming DataFrame with a TIMESTAMP column and returns one;
state is bounded by a watermark or by a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.operators.sketches import sketch_bin
from flowlens.operators.traces import _contains, _parsed


def read_events(spark, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``ts`` becomes a TIMESTAMP, which watermarks need.

    All files that are there go into one batch, so that the watermark of one drops no row of
    another; ``files_per_trigger`` is for files that are in order of time.
    """
    reader = spark.readStream.schema(schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def timing_buffer(events: DataFrame, keys: list[str], value: str, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sketch rows (window_start, keys, bin, n, least, most) of each tumbling window, final once the watermark is past it."""
    v = F.col(value).cast("double")
    rows = events.withWatermark("ts", late).where(v > 0)
    found = rows.groupBy(F.window("ts", every).alias("w"), *keys, sketch_bin(v).alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))
    return found.select(F.col("w.start").alias("window_start"), *keys, "bin", "n", "least", "most")


def throughput(events: DataFrame, keys: list[str], every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("bucket"), *keys, "n")


def smoothed_rates(counts: DataFrame, key: str, seconds: float, alpha: float = 0.25, silent: int = 10, late: str = "1 minute") -> DataFrame:
    """(key, at, rate): the smoothed rate of each key after each cycle of ``counts`` (key, at, n), cycles in order.

    A cycle without a row for a key counts as 0 when the next one comes. State is one
    number and one time a key, dropped once the watermark, ``late`` behind the newest row,
    is ``silent`` cycles past the key's last one.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rate, last = state.get if state.exists else (None, None)
        out = []
        for at, n in sorted((r.at, r.n) for f in frames for r in f.itertuples()):
            now = at.timestamp()
            if last is not None:
                for _ in range(round((now - last) / seconds) - 1):
                    rate *= 1 - alpha
            raw = n / max(seconds, 1.0)
            rate, last = (raw if rate is None else alpha * raw + (1 - alpha) * rate), now
            out.append((k[0], at, rate))
        state.update((rate, last))
        state.setTimeoutTimestamp(max(int((last + seconds * silent) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "at", "rate"])

    rows = counts.select(key, F.col("at").cast("timestamp").alias("at"), "n").withWatermark("at", late)
    kind = counts.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at timestamp, rate double", "rate double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def waking(signals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(wait_id, event_id, outcome): waits woken by the first event that fits, or timed out; each leaves once.

    ``signals`` mixes both: queue, name, ts, wait_id and predicate and timeout_at of a
    wait, event_id and payload of an event. State is the open waits of a queue and
    name; a wait without a timeout is kept until an event comes.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, wants, limits = (list(x) for x in state.get) if state.exists else ([], [], [])
        out: list[tuple] = []

        def expire(now: float) -> None:
            for i in [i for i, t in enumerate(limits) if t <= now][::-1]:
                out.append((ids.pop(i), None, "TIMED_OUT"))
                wants.pop(i)
                limits.pop(i)

        if state.hasTimedOut:
            expire(state.getCurrentWatermarkMs() / 1000)
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame()
        for r in rows.sort_values(["ts", "event_id"], na_position="first").itertuples() if len(rows) else ():
            expire(r.ts.timestamp())
            if not pd.isna(r.wait_id):
                ids.append(int(r.wait_id))
                wants.append(r.predicate or "{}")
                limits.append(float("inf") if pd.isna(r.timeout_at) else r.timeout_at.timestamp())
            else:
                payload = _parsed(r.payload)
                for i in [i for i, w in enumerate(wants) if _contains(payload, _parsed(w))][::-1]:
                    out.append((ids.pop(i), int(r.event_id), "EVENT"))
                    wants.pop(i)
                    limits.pop(i)
        if ids:
            state.update((ids, wants, limits))
            soonest = min(limits)
            if soonest != float("inf"):
                state.setTimeoutTimestamp(max(int(soonest * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["wait_id", "event_id", "outcome"]).astype({"wait_id": "Int64", "event_id": "Int64"})

    rows = signals.withWatermark("ts", late).select("queue", "name", "ts", "wait_id", "predicate", "timeout_at", "event_id", "payload")
    return rows.groupBy("queue", "name").applyInPandasWithState(step, "wait_id bigint, event_id bigint, outcome string", "ids array<bigint>, wants array<string>, limits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_broadcast(cycles: DataFrame, as_of, fresh: str = "30 seconds") -> DataFrame:
    """Batch form of the metrics cache: each namespace's last cycle, and whether it is still fresh."""
    last = cycles.groupBy("namespace_id").agg(F.max("at").alias("at"), F.max_by("payload", "at").alias("payload"))
    return last.withColumn("fresh", F.col("at") >= as_of - F.expr(f"INTERVAL {fresh}"))
