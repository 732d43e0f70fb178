"""Queries of operators/metrics.py over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.sources import model as S

T, R, E = S.TASKS_SQL, f"{S.TASKS_SQL}, {S.RUNS_SQL}", S.EVENTS_SQL
NOW = lambda: S.as_of(S.TASKS_AS_OF)
EVENT_NOW = lambda: S.as_of(S.EVENTS_AS_OF)
N = f"TIMESTAMP '{S.TASKS_AS_OF}'"
MONTH, YEAR = 24 * 30, 24 * 365


def _markers(spark, d):
    return S.tasks(spark, d).where("kind = 'WORKFLOW'").select(F.concat(F.lit("change-"), (F.col("id") % 7).cast("string")).alias("change_id"), "state", ((F.col("id") % 7 == 3) | (F.col("id") % 2 == 0)).alias("value"))


def _workers(spark, d):
    k = F.col("s_suppkey")
    named = F.explode(F.array(F.lit("ASIA"), F.lit("EUROPE"))).alias("namespace_id")
    seen = F.timestamp_add("SECOND", (-(k % 90)).cast("int"), NOW()).alias("updated_at")
    return S.table(spark, d, "supplier").select(named, k.alias("worker_id"), (4 + k % 5).cast("int").alias("concurrency"), seen)


def _worker_runs(spark, d):
    cancelled = (F.col("state") == "FAILED") & (F.col("task_id") % 4 == 1)
    return S.runs(spark, d).withColumn("state", F.when(cancelled, "CANCELLED").otherwise(F.col("state")))


def _backfills(spark, d):
    return spark.range(6).select(F.col("id").alias("backfill_id"), (F.col("id") * 100).alias("total_slots"))


def _triggers(spark, d):
    return S.events(spark, d).where("id % 3 = 0").select(F.col("id").alias("emission_id"), F.explode(F.sequence(F.lit(0), (F.col("user_id") % 3).cast("int"))).alias("k"), "user_id", "created_at").select(
        "emission_id", (F.col("user_id") * 10 + F.col("k")).alias("task_id"), F.timestamp_add("SECOND", F.col("k") * 5, F.col("created_at")).alias("triggered_at")
    )


QUERIES = {
    "queue_stats": (
        lambda s, d: M.queue_stats(S.tasks(s, d), S.queues(s, d), NOW(), hours=MONTH),
        f"""WITH {T}, {S.QUEUES_SQL} SELECT q.namespace_id, q.queue, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'RUNNING') AS running,
        count(*) FILTER (state = 'SLEEPING') AS sleeping, count(*) FILTER (state = 'WAITING') AS waiting, count(*) FILTER (state = 'FAILED' AND created_at >= {N} - INTERVAL 30 DAY) AS failed
        FROM queues q LEFT JOIN tasks t ON q.namespace_id = t.namespace_id AND q.queue = t.queue GROUP BY ALL""",
    ),
    "queue_stats_roots": (
        lambda s, d: M.queue_stats(S.tasks(s, d), S.queues(s, d), NOW(), root_only=True),
        f"""WITH {T}, {S.QUEUES_SQL} SELECT q.namespace_id, q.queue, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'RUNNING') AS running,
        count(*) FILTER (state = 'SLEEPING') AS sleeping, count(*) FILTER (state = 'WAITING') AS waiting, count(*) FILTER (state = 'FAILED' AND created_at >= {N} - INTERVAL 24 HOUR) AS failed
        FROM queues q LEFT JOIN tasks t ON q.namespace_id = t.namespace_id AND q.queue = t.queue AND parent_id IS NULL GROUP BY ALL""",
    ),
    "task_definitions": (
        lambda s, d: M.task_definitions(S.tasks(s, d)).withColumn("avg_ms", F.round("avg_ms", 3)),
        f"""WITH {T} SELECT name, kind, count(*) AS total, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state IN ('PENDING', 'SLEEPING', 'WAITING')) AS queued,
        count(*) FILTER (state = 'FAILED') AS failed, max(created_at) AS last_seen, round(avg(date_diff('microsecond', created_at, completed_at) / 1000.0) FILTER (state = 'COMPLETED'), 3) AS avg_ms
        FROM tasks WHERE parent_id IS NULL GROUP BY name, kind""",
    ),
    "definition_activity": (
        lambda s, d: M.definition_activity(S.tasks(s, d), "1-URGENT", NOW(), days=60),
        f"WITH {T} SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS total, count(*) FILTER (state = 'FAILED') AS failed FROM tasks WHERE name = '1-URGENT' AND parent_id IS NULL AND created_at >= {N} - INTERVAL 60 DAY GROUP BY 1",
    ),
    "workers": (
        lambda s, d: M.worker_activity(_workers(s, d), _worker_runs(s, d), NOW(), minutes=60 * MONTH),
        f"""WITH {R}, r AS (SELECT * REPLACE (CASE WHEN state = 'FAILED' AND task_id % 4 = 1 THEN 'CANCELLED' ELSE state END AS state) FROM runs),
        w AS (SELECT ns AS namespace_id, s_suppkey AS worker_id, CAST(4 + s_suppkey % 5 AS INTEGER) AS concurrency, {N} - to_seconds(s_suppkey % 90) AS updated_at FROM supplier, unnest(['ASIA', 'EUROPE']) AS t(ns)),
        a AS (SELECT namespace_id, worker_id, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed,
            count(*) FILTER (state = 'CANCELLED') AS cancelled, max(lease_expires_at) FILTER (state = 'RUNNING') AS lease
            FROM r WHERE state = 'RUNNING' OR finished_at > {N} - INTERVAL {60 * MONTH} MINUTE GROUP BY 1, 2)
        SELECT namespace_id, worker_id, concurrency, coalesce(running, 0) AS running, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled,
            coalesce(lease > {N}, false) OR updated_at > {N} - INTERVAL 30 SECOND AS healthy
        FROM w LEFT JOIN a USING (namespace_id, worker_id)""",
    ),
    "latency_percentiles": (
        lambda s, d: M.latency_percentiles(S.runs(s, d), NOW(), hours=YEAR * 3).withColumns({c: F.round(c, 3) for c in ("p50_ms", "p95_ms", "p99_ms")}),
        f"""WITH {R} SELECT name, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, round(quantile_cont(ms, 0.99), 3) AS p99_ms, min(ms) AS min_ms, max(ms) AS max_ms
        FROM (SELECT name, date_diff('microsecond', started_at, finished_at) / 1000.0 AS ms FROM runs WHERE state = 'COMPLETED' AND finished_at >= {N} - to_hours({YEAR * 3})) GROUP BY name ORDER BY n DESC, name LIMIT 50""",
    ),
    "latency_timeseries": (
        lambda s, d: M.latency_timeseries(S.runs(s, d), NOW(), hours=MONTH).withColumns({c: F.round(c, 3) for c in ("p50_ms", "p95_ms")}),
        f"""WITH {R} SELECT bucket, name, round(quantile_cont(ms, 0.5), 3) AS p50_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms, count(*) AS n
        FROM (SELECT date_trunc('hour', finished_at) AS bucket, name, date_diff('microsecond', started_at, finished_at) / 1000.0 AS ms FROM runs WHERE state = 'COMPLETED' AND finished_at >= {N} - to_hours({MONTH})) GROUP BY ALL""",
    ),
    "metrics_summary": (
        lambda s, d: M.metrics_summary(S.tasks(s, d), S.as_of("2001-05-01 00:00:00")),
        f"""WITH {T} SELECT count(*) FILTER (state = 'COMPLETED' AND completed_at >= TIMESTAMP '2001-05-01') AS completed, count(*) FILTER (state = 'FAILED' AND created_at >= TIMESTAMP '2001-05-01') AS failed,
        count(*) FILTER (state = 'CANCELLED' AND cancelled_at >= TIMESTAMP '2001-05-01') AS cancelled FROM tasks""",
    ),
    "metrics_throughput": (
        lambda s, d: M.throughput(S.tasks(s, d), NOW(), hours=24 * 7),
        f"""WITH {T}, spine AS (SELECT unnest(generate_series(date_trunc('hour', {N} - INTERVAL 7 DAY), date_trunc('hour', {N}), INTERVAL 1 HOUR)) AS bucket),
        c AS (SELECT date_trunc('hour', created_at) AS bucket, count(*) AS n FROM tasks WHERE state IN ('COMPLETED', 'FAILED', 'CANCELLED') AND created_at >= {N} - INTERVAL 7 DAY AND created_at <= {N} GROUP BY 1)
        SELECT bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (bucket)""",
    ),
    "metrics_throughput_days": (
        lambda s, d: M.throughput(S.tasks(s, d), NOW(), hours=24 * 90, unit="day"),
        f"""WITH {T}, spine AS (SELECT unnest(generate_series(date_trunc('day', {N} - INTERVAL 90 DAY), date_trunc('day', {N}), INTERVAL 1 DAY)) AS bucket),
        c AS (SELECT date_trunc('day', created_at) AS bucket, count(*) AS n FROM tasks WHERE state IN ('COMPLETED', 'FAILED', 'CANCELLED') AND created_at >= {N} - INTERVAL 90 DAY AND created_at <= {N} GROUP BY 1)
        SELECT bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN (SELECT bucket::TIMESTAMP AS bucket, n FROM c) USING (bucket)""",
    ),
    "metrics_error_rate": (
        lambda s, d: M.error_rate(S.tasks(s, d), NOW(), hours=24 * 30, unit="day"),
        f"WITH {T} SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS n FROM tasks WHERE state = 'FAILED' AND created_at >= {N} - INTERVAL 30 DAY GROUP BY 1",
    ),
    "metrics_error_share": (
        lambda s, d: M.error_share(S.tasks(s, d), NOW(), hours=24 * 5),
        f"""WITH {T}, spine AS (SELECT unnest(generate_series(date_trunc('hour', {N} - INTERVAL 5 DAY), date_trunc('hour', {N}), INTERVAL 1 HOUR)) AS bucket),
        c AS (SELECT date_trunc('hour', created_at) AS bucket, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed FROM tasks WHERE state IN ('COMPLETED', 'FAILED') AND created_at >= {N} - INTERVAL 5 DAY AND created_at <= {N} GROUP BY 1)
        SELECT bucket, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, failed / nullif(completed + failed, 0) AS share FROM spine LEFT JOIN c USING (bucket)""",
    ),
    "live_counts": (
        lambda s, d: M.live_counts(S.tasks(s, d)),
        f"WITH {T} SELECT count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state IN ('RUNNING', 'SLEEPING', 'WAITING')) AS running FROM tasks",
    ),
    "queue_state_counts": (
        lambda s, d: M.queue_state_counts(S.tasks(s, d), S.queues(s, d)),
        f"""WITH {T}, {S.QUEUES_SQL}, st AS (SELECT unnest(['PENDING', 'RUNNING', 'SLEEPING', 'WAITING']) AS state)
        SELECT 'Q' AS row_type, q.namespace_id, q.queue, NULL::VARCHAR AS state, count(t.id) AS cnt FROM queues q LEFT JOIN tasks t ON q.namespace_id = t.namespace_id AND q.queue = t.queue GROUP BY ALL
        UNION ALL SELECT 'C', q.namespace_id, q.queue, st.state, count(t.id) FROM queues q CROSS JOIN st LEFT JOIN tasks t ON q.namespace_id = t.namespace_id AND q.queue = t.queue AND t.state = st.state GROUP BY ALL""",
    ),
    "queue_pressure": (
        lambda s, d: M.queue_pressure(S.tasks(s, d), S.runs(s, d)),
        f"""WITH {R}, p AS (SELECT queue, count(*) FILTER (state = 'PENDING') AS pending FROM tasks GROUP BY 1), w AS (SELECT queue, count(DISTINCT worker_id) AS workers FROM runs GROUP BY 1)
        SELECT queue, pending, coalesce(workers, 0) AS workers, pending / nullif(workers, 0) AS pressure FROM p LEFT JOIN w USING (queue)""",
    ),
    "migration_status": (
        lambda s, d: M.migration_status(_markers(s, d)),
        f"""WITH {T}, m AS (SELECT 'change-' || (id % 7) AS change_id, state IN ('PENDING', 'RUNNING', 'SLEEPING', 'WAITING') AS live, id % 7 = 3 OR id % 2 = 0 AS value FROM tasks WHERE kind = 'WORKFLOW')
        SELECT change_id, count(*) FILTER (live AND NOT value) AS pending, count(*) FILTER (NOT live) AS completed, count(*) FILTER (live AND NOT value) = 0 AS safe FROM m GROUP BY 1""",
    ),
    "backfill_active": (
        lambda s, d: M.backfill_progress(S.tasks(s, d), _backfills(s, d)),
        f"""WITH {T}, b AS (SELECT unnest(generate_series(0, 5)) AS backfill_id), a AS (SELECT backfill_id, count(*) FILTER (state IN ('PENDING', 'RUNNING', 'SLEEPING', 'WAITING')) AS active,
            count(*) FILTER (state NOT IN ('PENDING', 'RUNNING', 'SLEEPING', 'WAITING')) AS done FROM tasks WHERE backfill_id IS NOT NULL GROUP BY 1)
        SELECT backfill_id, backfill_id * 100 AS total_slots, coalesce(active, 0) AS active, coalesce(done, 0) AS completed_slots, CASE WHEN backfill_id > 0 THEN coalesce(done, 0) / (backfill_id * 100) ELSE 0.0 END AS progress FROM b LEFT JOIN a USING (backfill_id)""",
    ),
    "county_stats": (
        lambda s, d: M.county_stats(S.measurements(s, d), F.lit("2029-01-15").cast("date")),
        f"""WITH {S.MEASUREMENTS_SQL}, a AS (SELECT county, count(*) AS n, count(DISTINCT site) AS sites, round(avg(depth), 3) AS avg_depth, min(depth) AS min_depth, max(depth) AS max_depth, round(stddev_samp(depth), 3) AS stddev_depth,
            round(count(*) FILTER (quality = 'Good') / nullif(count(*), 0) * 100, 1) AS pct_good, min(day) AS first_day, max(day) AS last_day,
            round(avg(depth) FILTER (day >= DATE '2024-01-15'), 3) AS recent_avg, round(avg(depth) FILTER (day >= DATE '2019-01-15' AND day < DATE '2024-01-15'), 3) AS prev_avg
            FROM measurements WHERE depth IS NOT NULL AND county IS NOT NULL GROUP BY county) SELECT *, round(recent_avg - prev_avg, 3) AS delta FROM a""",
    ),
    "distinct_counties": (lambda s, d: M.distinct_counties(S.measurements(s, d)), f"WITH {S.MEASUREMENTS_SQL} SELECT DISTINCT county FROM measurements WHERE county IS NOT NULL AND county <> ''"),
    "chunk_progress": (
        lambda s, d: M.chunk_progress(S.table(s, d, "events"), F.floor(F.col("event_id") / 1000), 1000),
        "SELECT event_id // 1000 AS chunk, count(*) AS n, round(count(*) / 1000 * 100, 1) AS pct FROM events GROUP BY 1",
    ),
    "event_triggers_json": (
        lambda s, d: M.events_with_triggers(S.events(s, d), _triggers(s, d)),
        f"""WITH {E}, tr AS (SELECT id AS emission_id, user_id * 10 + k AS task_id, created_at + to_seconds(k * 5) AS triggered_at FROM ev, unnest(generate_series(0, user_id % 3)) AS t(k) WHERE id % 3 = 0),
        l AS (SELECT emission_id, '[' || string_agg('{{"task_id":' || task_id || ',"triggered_at":"' || strftime(triggered_at, '%Y-%m-%d %H:%M:%S') || '"}}', ',' ORDER BY triggered_at DESC, task_id DESC) || ']' AS j FROM tr GROUP BY 1)
        SELECT id, name, coalesce(j, '[]') AS triggers FROM ev LEFT JOIN l ON id = emission_id""",
    ),
}
