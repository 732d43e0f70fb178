"""Aggregates over tasks, runs, spans and measurements.

All take an explicit ``as_of`` column in place of the clock, and read each input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.columns import LIVE, millis_between


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def queue_stats(tasks: DataFrame, queues: DataFrame, as_of: Column, root_only: bool = False, hours: int = 24) -> DataFrame:
    """Tasks of each queue by live state, and those created in the last ``hours`` that failed.

    One conditional aggregate; queues without tasks have zeros.
    """
    rows = tasks.where(F.col("parent_id").isNull()) if root_only else tasks
    state = F.col("state")
    found = rows.groupBy("namespace_id", "queue").agg(
        *[_n(state == s).alias(s.lower()) for s in LIVE], _n((state == "FAILED") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))).alias("failed")
    )
    counts = [s.lower() for s in LIVE] + ["failed"]
    return queues.join(found, ["namespace_id", "queue"], "left").select("namespace_id", "queue", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def task_definitions(tasks: DataFrame) -> DataFrame:
    """Root tasks by name and kind: how many, in which states, last seen, mean time to completion."""
    state, took = F.col("state"), millis_between("created_at", "completed_at")
    return tasks.where(F.col("parent_id").isNull()).groupBy("name", "kind").agg(
        F.count("*").alias("total"), _n(state == "RUNNING").alias("running"), _n(state.isin("PENDING", "SLEEPING", "WAITING")).alias("queued"), _n(state == "FAILED").alias("failed"),
        F.max("created_at").alias("last_seen"), F.avg(F.when(state == "COMPLETED", took)).alias("avg_ms"),
    )


def definition_activity(tasks: DataFrame, name: str, as_of: Column, days: int = 1) -> DataFrame:
    """A definition's root tasks by day: all, and failed; ``days`` is held to 1..90."""
    days = min(90, max(1, days))
    rows = tasks.where((F.col("name") == name) & F.col("parent_id").isNull() & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    return rows.groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("total"), _n(F.col("state") == "FAILED").alias("failed"))


def worker_activity(workers: DataFrame, runs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Each worker's running runs, and those that ended in the last ``minutes``, in its namespace; and its health.

    A worker is healthy if the lease of a running run reaches past ``as_of``, or it was
    seen within 30 s. Leases of runs that have ended say nothing.
    """
    keys = [c for c in ("namespace_id", "worker_id") if c in workers.columns]
    running, ended = F.col("state") == "RUNNING", ("COMPLETED", "FAILED", "CANCELLED")
    recent = runs.where(running | (F.col("state").isin(*ended) & (F.col("finished_at") > as_of - F.expr(f"INTERVAL {minutes} MINUTES"))))
    counts = [_n(F.col("state") == s).alias(s.lower()) for s in ("RUNNING", *ended)]
    found = recent.where("worker_id is not null").groupBy(*keys).agg(*counts, F.max(F.when(running, F.col("lease_expires_at"))).alias("lease"))
    joined = workers.join(found, keys, "left")
    seen = F.col("updated_at") > as_of - F.expr("INTERVAL 30 SECONDS")
    healthy = F.coalesce(F.col("lease") > as_of, F.lit(False)) | F.coalesce(seen, F.lit(False))
    shown = [F.coalesce(s.lower(), F.lit(0)).alias(s.lower()) for s in ("RUNNING", *ended)]
    return joined.select(*keys, "concurrency", *shown, healthy.alias("healthy"))


def latency_percentiles(spans: DataFrame, as_of: Column, hours: int = 24, limit: int = 50) -> DataFrame:
    """Exact percentiles of completed spans' milliseconds by name, most frequent first; ``limit`` is held to 1..500."""
    limit = min(500, max(1, limit))
    rows = spans.where((F.col("state") == "COMPLETED") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull() & (F.col("finished_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    ms = rows.select("name", millis_between("started_at", "finished_at").alias("ms"))
    found = ms.groupBy("name").agg(F.count("*").alias("n"), F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))
    out = found.select("name", "n", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"), F.col("p")[2].alias("p99_ms"), "min_ms", "max_ms")
    return out.orderBy(F.desc("n"), "name").limit(limit)


def latency_timeseries(spans: DataFrame, as_of: Column, hours: int = 24, name: str | None = None) -> DataFrame:
    """Median and 95th percentile by bucket and name: minutes up to one hour, else hours."""
    rows = spans.where((F.col("state") == "COMPLETED") & F.col("started_at").isNotNull() & (F.col("finished_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    rows = rows.where(F.col("name") == name) if name is not None else rows
    bucket = F.date_trunc("minute" if hours <= 1 else "hour", "finished_at").cast("timestamp_ntz")
    ms = rows.select(bucket.alias("bucket"), "name", millis_between("started_at", "finished_at").alias("ms"))
    found = ms.groupBy("bucket", "name").agg(F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.count("*").alias("n"))
    return found.select("bucket", "name", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"), "n")


def metrics_summary(tasks: DataFrame, since: Column) -> DataFrame:
    """Completed (by completion), failed (by creation) and cancelled (by cancellation) tasks since a time."""
    state = F.col("state")
    return tasks.agg(_n((state == "COMPLETED") & (F.col("completed_at") >= since)).alias("completed"), _n((state == "FAILED") & (F.col("created_at") >= since)).alias("failed"), _n((state == "CANCELLED") & (F.col("cancelled_at") >= since)).alias("cancelled"))


def spine(df: DataFrame, start: Column, stop: Column, unit: str, name: str = "bucket") -> DataFrame:
    """One row per hour or day from ``start`` to ``stop``, both cut to the unit."""
    cut = lambda c: F.date_trunc(unit, c).cast("timestamp_ntz")
    return df.sparkSession.range(1).select(F.explode(F.sequence(cut(start), cut(stop), F.expr(f"INTERVAL 1 {unit.upper()}"))).alias(name))


def throughput(tasks: DataFrame, as_of: Column, hours: int = 24, unit: str = "hour") -> DataFrame:
    """Ended tasks by the hour or day they were created in, with zeros where there are none.

    The first bucket is partial: it begins with the window, not with the hour.
    """
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    rows = tasks.where(F.col("state").isin("COMPLETED", "FAILED", "CANCELLED") & (F.col("created_at") >= since) & (F.col("created_at") <= as_of))
    counts = rows.groupBy(F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    return spine(tasks, since, as_of, unit).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def error_rate(tasks: DataFrame, as_of: Column, hours: int = 24, unit: str = "hour") -> DataFrame:
    """Failed tasks by bucket of creation; buckets without any are left out."""
    rows = tasks.where((F.col("state") == "FAILED") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    return rows.groupBy(F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


def error_share(tasks: DataFrame, as_of: Column, hours: int = 24, unit: str = "hour") -> DataFrame:
    """Completed and failed tasks by bucket, and failed / (completed + failed), null where both are 0."""
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    rows = tasks.where(F.col("state").isin("COMPLETED", "FAILED") & (F.col("created_at") >= since) & (F.col("created_at") <= as_of))
    found = rows.groupBy(F.date_trunc(unit, "created_at").cast("timestamp_ntz").alias("bucket")).agg(_n(F.col("state") == "COMPLETED").alias("completed"), _n(F.col("state") == "FAILED").alias("failed"))
    both = F.col("completed") + F.col("failed")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine(tasks, since, as_of, unit).join(found, "bucket", "left").select("bucket", zero("completed"), zero("failed"), (F.col("failed") / both).alias("share"))


def live_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(_n(F.col("state") == "PENDING").alias("pending"), _n(F.col("state").isin("RUNNING", "SLEEPING", "WAITING")).alias("running"))


def queue_state_counts(tasks: DataFrame, queues: DataFrame) -> DataFrame:
    """Long form: a row Q for each queue with all its tasks, and a row C for each queue and live state, zeros too."""
    by_state = tasks.groupBy("namespace_id", "queue", "state").agg(F.count("*").alias("cnt"))
    total = queues.join(by_state.groupBy("namespace_id", "queue").agg(F.sum("cnt").alias("cnt")), ["namespace_id", "queue"], "left")
    grid = queues.select("namespace_id", "queue", F.explode(F.array(*map(F.lit, LIVE))).alias("state")).join(by_state, ["namespace_id", "queue", "state"], "left")
    cnt = F.coalesce("cnt", F.lit(0)).alias("cnt")
    return total.select(F.lit("Q").alias("row_type"), "namespace_id", "queue", F.lit(None).cast("string").alias("state"), cnt).unionByName(grid.select(F.lit("C").alias("row_type"), "namespace_id", "queue", "state", cnt))


def queue_pressure(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending tasks of each queue over the number of workers that have run in it; null without workers."""
    pending = tasks.groupBy("queue").agg(_n(F.col("state") == "PENDING").alias("pending"))
    workers = runs.select("queue", "worker_id").distinct().groupBy("queue").agg(F.count("*").alias("workers"))
    return pending.join(workers, "queue", "left").select("queue", "pending", F.coalesce("workers", F.lit(0)).alias("workers"), (F.col("pending") / F.col("workers")).alias("pressure"))


def migration_status(markers: DataFrame) -> DataFrame:
    """By change: tasks still on the old path, tasks done with it, and whether the old path can go."""
    live = F.col("state").isin(*LIVE)
    old = _n(live & ~F.col("value"))
    return markers.groupBy("change_id").agg(old.alias("pending"), _n(~live).alias("completed"), (old == 0).alias("safe"))


def backfill_progress(tasks: DataFrame, backfills: DataFrame) -> DataFrame:
    """Each backfill's live tasks, ended ones and share done, 0 where it has no slots."""
    live = F.col("state").isin(*LIVE)
    found = tasks.where(F.col("backfill_id").isNotNull()).groupBy("backfill_id").agg(_n(live).alias("active"), _n(~live).alias("completed_slots"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.when(F.col("total_slots") > 0, zero("completed_slots") / F.col("total_slots")).otherwise(0.0)
    return backfills.join(found, "backfill_id", "left").select("backfill_id", "total_slots", zero("active").alias("active"), zero("completed_slots").alias("completed_slots"), share.alias("progress"))


def county_stats(measurements: DataFrame, today: Column) -> DataFrame:
    """Statistics of each county's readings, and how the last five years differ from the five before.

    Readings without a depth don't count; the trend is the difference of rounded means.
    """
    depth, day = F.col("depth"), F.col("day")
    rows = measurements.where(depth.isNotNull() & F.col("county").isNotNull())
    recent, before = day >= F.add_months(today, -60), (day >= F.add_months(today, -120)) & (day < F.add_months(today, -60))
    found = rows.groupBy("county").agg(
        F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.round(F.avg(depth), 3).alias("avg_depth"), F.min(depth).alias("min_depth"), F.max(depth).alias("max_depth"), F.round(F.stddev_samp(depth), 3).alias("stddev_depth"),
        F.round(_n(F.col("quality") == "Good") / F.nullif(F.count("*"), F.lit(0)) * 100, 1).alias("pct_good"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.round(F.avg(F.when(recent, depth)), 3).alias("recent_avg"), F.round(F.avg(F.when(before, depth)), 3).alias("prev_avg"),
    )
    return found.withColumn("delta", F.round(F.col("recent_avg") - F.col("prev_avg"), 3))


def distinct_counties(measurements: DataFrame) -> DataFrame:
    return measurements.where("county is not null and county <> ''").select("county").distinct()


def chunk_progress(measurements: DataFrame, chunk: Column, expected: int) -> DataFrame:
    """Rows of each chunk, and the share of ``expected`` that is there, in percent."""
    return measurements.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(expected) * 100, 1).alias("pct"))


def events_with_triggers(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each event with the tasks it woke as a JSON list, latest first; [] for none."""
    item = F.struct(F.col("triggered_at"), F.col("task_id"))
    lists = triggers.groupBy("emission_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("l"))
    as_json = F.to_json(F.transform("l", lambda x: F.struct(x["task_id"].alias("task_id"), F.date_format(x["triggered_at"], "yyyy-MM-dd HH:mm:ss").alias("triggered_at"))))
    return events.join(lists, events["id"] == lists["emission_id"], "left").select("id", "name", F.coalesce(as_json, F.lit("[]")).alias("triggers"))
