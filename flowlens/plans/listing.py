"""Queries of operators/listing.py and sources/wells.py over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import listing as L
from flowlens.operators import metrics
from flowlens.plans import traces
from flowlens.plans.metrics import _triggers
from flowlens.sources import model as S
from flowlens.sources import wells

T, R, E = S.TASKS_SQL, f"{S.TASKS_SQL}, {S.RUNS_SQL}", S.EVENTS_SQL
NOW = lambda: S.as_of(S.TASKS_AS_OF)
EVENT_NOW = lambda: S.as_of(S.EVENTS_AS_OF)

WAITS_SQL = "waits AS (SELECT user_id AS id, 'ev' || (user_id % 5) AS event_name, queue, min(created_at) AS created_at FROM ev GROUP BY user_id, queue)"
SCHEDULES_SQL = """schedules AS (SELECT s_suppkey AS id, 'q' || (s_suppkey % 7) AS queue, s_name AS name, s_suppkey % 4 <> 0 AS is_active, TIMESTAMP '2024-01-30 00:00:00' + to_minutes(s_suppkey * 37 % 2880) AS next_run_at,
    CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-15' END AS starts_at, CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-20' + to_days(s_suppkey % 20) END AS ends_at FROM supplier)"""


def waits(spark, d):
    return S.events(spark, d).groupBy(F.col("user_id").alias("id"), "queue").agg(F.min("created_at").alias("created_at")).select("id", F.concat(F.lit("ev"), (F.col("id") % 5).cast("string")).alias("event_name"), "queue", "created_at")


def schedules(spark, d):
    k = F.col("s_suppkey")
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return S.table(spark, d, "supplier").select(
        k.alias("id"), F.concat(F.lit("q"), (k % 7).cast("string")).alias("queue"), F.col("s_name").alias("name"), (k % 4 != 0).alias("is_active"), F.timestamp_add("MINUTE", (k * 37 % 2880).cast("int"), t("2024-01-30 00:00:00")).alias("next_run_at"),
        F.when(k % 3 == 0, t("2024-01-15 00:00:00")).alias("starts_at"), F.when(k % 5 == 0, F.timestamp_add("DAY", (k % 20).cast("int"), t("2024-01-20 00:00:00"))).alias("ends_at"),
    )


_PAGE = ("pos", "id", "state", "name", "more")

_BACKFILLS_SQL = "bf AS (SELECT id, namespace_id, queue, name, created_at, CASE id % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'PAUSED' ELSE 'DONE' END AS status FROM tasks WHERE id % 5 = 0)"


def _backfills(spark, d):
    k = F.col("id")
    status = F.when(k % 3 == 0, "RUNNING").when(k % 3 == 1, "PAUSED").otherwise("DONE").alias("status")
    return S.tasks(spark, d).where(k % 5 == 0).select("id", "namespace_id", "queue", "name", "created_at", status)


def _checkpoints(spark, d):
    rows = S.runs(spark, d).withColumn("seq", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    return rows.select("task_id", "attempt", "seq", F.timestamp_add("SECOND", 100 - F.col("seq"), F.col("started_at")).alias("written_at"), (F.col("worker_id") + F.col("seq")).alias("value"))


def _lines(spark, d):
    """Events as CSV lines: quotes, empty fields, lines of 17 and 18 fields, and such without a site."""
    k, none = F.col("id"), F.lit("")
    fields = [none] * 19
    fields[0], fields[1] = k.cast("string"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" s"), F.col("user_id").cast("string")))
    fields[2], fields[6] = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 7 == 0, none).otherwise(((k % 1000) / 4).cast("string"))
    fields[7], fields[15] = F.when(k % 3 == 0, '"Good, ""checked"""').otherwise('""'), F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    fields[17], fields[18] = F.when(k % 4 == 0, none).otherwise("x"), F.lit("c")
    cut = F.when(k % 11 == 0, 17).when(k % 5 == 0, 18).otherwise(19)
    return S.events(spark, d).select(F.array_join(F.slice(F.array(*fields), F.lit(1), cut), ",").alias("value"))


QUERIES = {
    "list_tasks": (
        lambda s, d: L.list_tasks(S.tasks(s, d), 50, before=900, root_only=True, state="FAILED").select(*_PAGE),
        f"""WITH {T}, p AS (SELECT row_number() OVER (ORDER BY id DESC) AS pos, id, state, name, count(*) OVER () > 50 AS more FROM tasks WHERE id < 900 AND parent_id IS NULL AND state = 'FAILED') SELECT * FROM p WHERE pos <= 50""",
    ),
    "list_children": (
        lambda s, d: L.list_children(S.tasks(s, d), 25).select(*_PAGE),
        f"WITH {T} SELECT row_number() OVER (ORDER BY id DESC) AS pos, id, state, name, count(*) OVER () > 50 AS more FROM tasks WHERE parent_id = 25",
    ),
    "list_events": (
        lambda s, d: L.list_events(S.events(s, d), 40, before=S.as_of("2024-01-20 00:00:00"), name="click").select("pos", "id", "created_at"),
        f"WITH {E} SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, id, created_at FROM ev WHERE name = 'click' AND created_at < TIMESTAMP '2024-01-20' QUALIFY pos <= 40",
    ),
    "list_schedules": (
        lambda s, d: L.list_schedules(schedules(s, d), 10, after=("q2", "Supplier#000000009")).select("pos", "queue", "name"),
        f"WITH {SCHEDULES_SQL} SELECT row_number() OVER (ORDER BY queue, name) AS pos, queue, name FROM schedules WHERE queue > 'q2' OR (queue = 'q2' AND name > 'Supplier#000000009') QUALIFY pos <= 10",
    ),
    "list_runs": (
        lambda s, d: L.list_runs(S.runs(s, d), 42).select("pos", "attempt", "state", "worker_id"),
        f"WITH {R} SELECT row_number() OVER (ORDER BY attempt DESC) AS pos, attempt, state, worker_id FROM runs WHERE task_id = 42",
    ),
    "latest_runs": (
        lambda s, d: L.latest_runs(S.runs(s, d)),
        f"WITH {R} SELECT task_id, attempt, state, worker_id, started_at, finished_at FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) = 1",
    ),
    "task_results": (
        lambda s, d: L.task_results(S.tasks(s, d), S.runs(s, d)),
        f"""WITH {R}, l AS (SELECT task_id, attempt, state FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) = 1)
        SELECT id, t.state, attempt, l.state AS run_state FROM tasks t LEFT JOIN l ON task_id = id WHERE t.state IN ('COMPLETED', 'FAILED', 'CANCELLED')""",
    ),
    "worker_recent_runs": (
        lambda s, d: L.worker_recent_runs(S.runs(s, d), 3).select("pos", "task_id", "attempt", "started_at"),
        f"WITH {R} SELECT row_number() OVER (ORDER BY started_at DESC NULLS LAST, task_id DESC, attempt DESC) AS pos, task_id, attempt, started_at FROM runs WHERE worker_id = 3 QUALIFY pos <= 50",
    ),
    "task_kinds": (lambda s, d: L.task_kinds(S.tasks(s, d)), f"WITH {T} SELECT name, kind, queue FROM tasks QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind, queue) = 1"),
    "event_waiters": (
        lambda s, d: L.event_waiters(waits(s, d), "ev3").select("pos", "id", "created_at"),
        f"WITH {E}, {WAITS_SQL} SELECT row_number() OVER (ORDER BY created_at, id) AS pos, id, created_at FROM waits WHERE event_name = 'ev3' QUALIFY pos <= 20",
    ),
    "event_trigger_for_task": (
        lambda s, d: L.latest_trigger(_triggers(s, d)),
        f"""WITH {E}, tr AS (SELECT id AS emission_id, user_id * 10 + k AS task_id, created_at + to_seconds(k * 5) AS triggered_at FROM ev, unnest(generate_series(0, user_id % 3)) AS t(k) WHERE id % 3 = 0)
        SELECT task_id, triggered_at, emission_id FROM tr QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY triggered_at DESC, emission_id DESC) = 1""",
    ),
    "latest_events": (
        lambda s, d: L.latest_events(S.events(s, d)),
        f"WITH {E} SELECT queue, name, payload, created_at FROM ev QUALIFY row_number() OVER (PARTITION BY queue, name ORDER BY created_at DESC, id DESC) = 1",
    ),
    "due_schedules": (
        lambda s, d: L.due_schedules(schedules(s, d), EVENT_NOW()).select("pos", "id", "next_run_at"),
        f"""WITH {SCHEDULES_SQL} SELECT row_number() OVER (ORDER BY next_run_at, id) AS pos, id, next_run_at FROM schedules WHERE is_active AND next_run_at <= TIMESTAMP '2024-01-31' AND (starts_at IS NULL OR starts_at <= TIMESTAMP '2024-01-31')
        AND (ends_at IS NULL OR ends_at > TIMESTAMP '2024-01-31') QUALIFY pos <= 100""",
    ),
    "next_fire_time": (lambda s, d: L.next_fire_time(schedules(s, d)), f"WITH {SCHEDULES_SQL} SELECT min(next_run_at) AS next_run_at FROM schedules WHERE is_active"),
    "schedule_runs": (
        lambda s, d: L.schedule_runs(S.tasks(s, d), 7).select("pos", "id", "state", "created_at"),
        f"WITH {T} SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, id, state, created_at FROM tasks WHERE schedule_id = 7 QUALIFY pos <= 100",
    ),
    "completed_children": (
        lambda s, d: L.completed_children(S.tasks(s, d).withColumn("key", F.concat_ws(":", "parent_id", F.col("id") % 4)), S.runs(s, d), 25),
        f"""WITH {R}, l AS (SELECT task_id, max(attempt) AS attempt FROM runs GROUP BY 1) SELECT id, state, CAST(id % 4 AS INTEGER) AS seq, attempt FROM tasks LEFT JOIN l ON task_id = id
        WHERE parent_id = 25 AND state IN ('COMPLETED', 'FAILED', 'CANCELLED')""",
    ),
    "next_seq": (
        lambda s, d: L.next_seq(S.runs(s, d).select("task_id", F.col("attempt").alias("seq"))),
        f"WITH {R} SELECT task_id, max(attempt) + 1 AS next_seq FROM runs GROUP BY 1",
    ),
    "get_task": (lambda s, d: L.lookup(S.tasks(s, d), 42).select("id", "namespace_id", "state"), f"WITH {T} SELECT id, namespace_id, state FROM tasks WHERE id = 42"),
    "get_run": (lambda s, d: L.lookup(S.runs(s, d), 42, key="task_id").select("task_id", "attempt", "state"), f"WITH {T}, {S.RUNS_SQL} SELECT task_id, attempt, state FROM runs WHERE task_id = 42"),
    "workflow_by_key": (
        lambda s, d: L.workflow_by_key(S.tasks(s, d).withColumn("key", F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))), S.runs(s, d), "NATION_7", "w7"),
        f"WITH {T}, {S.RUNS_SQL} SELECT task_id, attempt FROM runs WHERE queue = 'NATION_7' AND task_id % 50 = 7 ORDER BY attempt DESC, task_id DESC LIMIT 1",
    ),
    "list_history": (
        lambda s, d: L.list_history(traces.history(s, d), 44, ("SLEEP", "WAIT")).select("pos", "task_id", "seq", "kind", "phase", "at"),
        f"WITH {T}, {S.RUNS_SQL}, {traces.HISTORY_SQL} SELECT row_number() OVER (ORDER BY seq) AS pos, task_id, seq, kind, phase, ts AS at FROM h WHERE task_id = 44 AND kind IN ('SLEEP', 'WAIT')",
    ),
    "list_checkpoints": (
        lambda s, d: L.list_checkpoints(_checkpoints(s, d), 7, 1).select("pos", "seq", "value"),
        f"WITH {T}, {S.RUNS_SQL}, c AS (SELECT *, k AS seq, started_at + to_seconds(100 - k) AS written_at, worker_id + k AS value FROM runs, unnest([1, 2, 3, 4]) AS t(k)) SELECT row_number() OVER (ORDER BY written_at, seq) AS pos, CAST(seq AS INTEGER) AS seq, value FROM c WHERE task_id = 7 AND attempt = 1",
    ),
    "backfills_running": (
        lambda s, d: L.backfills_running(_backfills(s, d), "ASIA").select("pos", "id"),
        f"WITH {T}, {_BACKFILLS_SQL} SELECT row_number() OVER (ORDER BY created_at, id) AS pos, id FROM bf WHERE namespace_id = 'ASIA' AND status = 'RUNNING' QUALIFY pos <= 50",
    ),
    "backfills_for_queue": (
        lambda s, d: L.backfills_for_queue(_backfills(s, d), "NATION_3", "2-HIGH").select("pos", "id"),
        f"WITH {T}, {_BACKFILLS_SQL} SELECT row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos, id FROM bf WHERE queue = 'NATION_3' AND name = '2-HIGH' QUALIFY pos <= 20",
    ),
    "busiest_timings": (
        lambda s, d: L.busiest(S.events(s, d).groupBy(F.concat_ws("/", "queue", "name").alias("name")).agg(F.count("*").alias("n")), 86400.0),
        f"WITH {S.EVENTS_SQL} SELECT queue || '/' || name AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, queue || '/' || name) AS pos, count(*) / 86400.0::DOUBLE AS rate FROM ev GROUP BY 1 QUALIFY pos <= 20",
    ),
    "state_totals": (
        lambda s, d: L.state_totals(metrics.queue_stats(S.tasks(s, d), S.queues(s, d), S.as_of(S.TASKS_AS_OF)), ("pending", "running", "sleeping", "waiting")),
        f"WITH {T} SELECT count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'SLEEPING') AS sleeping, count(*) FILTER (state = 'WAITING') AS waiting FROM tasks",
    ),
    "children_by_outcome": (
        lambda s, d: L.children_by_outcome(S.tasks(s, d)).select("parent_id", F.array_join(F.col("completed").cast("array<string>"), ",").alias("completed"), F.array_join(F.col("failed").cast("array<string>"), ",").alias("failed")),
        f"""WITH {T} SELECT parent_id, coalesce(array_to_string(array_agg(id ORDER BY id) FILTER (state = 'COMPLETED'), ','), '') AS completed, coalesce(array_to_string(array_agg(id ORDER BY id) FILTER (state = 'FAILED'), ','), '') AS failed FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1""",
    ),
    "with_ordinality": (
        lambda s, d: L.with_ordinality(S.table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("w")), "w", "word"),
        "SELECT p_partkey, w.unnest AS word, w.ordinality AS n FROM part, unnest(string_split(p_name, ' ')) WITH ORDINALITY AS w(unnest, ordinality)",
    ),
    "unsatisfied_waits": (
        lambda s, d: L.unsatisfied_waits(S.tasks(s, d).where("state = 'WAITING'").select(F.col("id").alias("task_id"), "name"), S.runs(s, d).where("state = 'COMPLETED'")),
        f"WITH {T}, {S.RUNS_SQL} SELECT id AS task_id, name FROM tasks WHERE state = 'WAITING' AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.task_id = tasks.id AND r.name = tasks.name AND r.state = 'COMPLETED')",
    ),
    "predicate_path": (
        lambda s, d: S.events(s, d).select("id", L.predicate("a.b", F.col("name")).alias("p"), L.predicate("k", F.col("user_id")).alias("q")),
        f"""WITH {S.EVENTS_SQL} SELECT id, '{{"a":{{"b":"' || name || '"}}}}' AS p, '{{"k":' || user_id || '}}' AS q FROM ev""",
    ),
    "csv_wells": (
        lambda s, d: wells.parse_lines(_lines(s, d)).select("_id", "site_code", "msmt_date", F.col("gse_gwe").cast("double").alias("depth"), "wlm_qa_desc", "county_name", "source", "msmt_cmt"),
        f"""WITH {S.EVENTS_SQL} SELECT CAST(id AS VARCHAR) AS _id, 's' || user_id AS site_code, CAST(created_at AS DATE) AS msmt_date, CASE WHEN id % 7 <> 0 THEN CAST(id % 1000 AS DOUBLE) / 4 END AS depth,
            CASE WHEN id % 3 = 0 THEN 'Good, "checked"' END AS wlm_qa_desc, name AS county_name, CASE WHEN id % 4 <> 0 THEN 'x' END AS source, CASE WHEN id % 5 <> 0 THEN 'c' END AS msmt_cmt FROM ev WHERE id % 11 <> 0 AND id % 13 <> 0""",
    ),
}
