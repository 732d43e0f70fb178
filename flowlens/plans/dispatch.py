"""Queries of operators/dispatch.py over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import dispatch as D
from flowlens.sources import model as S

T, R, E = S.TASKS_SQL, f"{S.TASKS_SQL}, {S.RUNS_SQL}", S.EVENTS_SQL
NOW = lambda: S.as_of(S.TASKS_AS_OF)
N = f"TIMESTAMP '{S.TASKS_AS_OF}'"

CAND_SQL = f"""cand AS (SELECT id, namespace_id, queue, state, CASE WHEN id % 23 = 0 THEN 'CANCELLED' ELSE 'RUNNING' END AS task_state, kind, priority, fairness_key, fairness_weight, id % 9 AS worker_id, created_at + to_hours(id % 48) AS available_at,
    CASE WHEN id % 6 = 0 THEN created_at + to_days(id % 4000) END AS deadline_at, CASE WHEN id % 5 < 3 THEN CAST(600 * (id % 50000) AS INTEGER) END AS start_timeout_s FROM tasks)"""
PASS_SQL = "passes AS (SELECT namespace_id, queue, fairness_key, CAST(sum(priority) AS DOUBLE) AS pass FROM tasks WHERE state = 'COMPLETED' AND fairness_key IS NOT NULL GROUP BY 1, 2, 3)"
FRONT_SQL = f"""due AS (SELECT * FROM cand WHERE state IN ('PENDING', 'SLEEPING') AND available_at <= {N}),
front AS (SELECT * FROM due WHERE fairness_key IS NULL UNION ALL
    (SELECT * FROM due WHERE fairness_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY namespace_id, queue, fairness_key ORDER BY priority, available_at, id) = 1))"""


def candidates(spark, d):
    k = F.col("id")
    return S.tasks(spark, d).select(
        "id", "namespace_id", "queue", "state", F.when(k % 23 == 0, "CANCELLED").otherwise("RUNNING").alias("task_state"), "kind", "priority", "fairness_key", "fairness_weight", (k % 9).alias("worker_id"), F.timestamp_add("HOUR", (k % 48).cast("int"), F.col("created_at")).alias("available_at"),
        F.when(k % 6 == 0, F.timestamp_add("DAY", (k % 4000).cast("int"), F.col("created_at"))).alias("deadline_at"), F.when(k % 5 < 3, (600 * (k % 50000)).cast("int")).alias("start_timeout_s"),
    )


def passes(spark, d):
    return S.tasks(spark, d).where("state = 'COMPLETED' and fairness_key is not null").groupBy("namespace_id", "queue", "fairness_key").agg(F.sum("priority").cast("double").alias("pass"))


def _due(spark, d):
    return candidates(spark, d).where(F.col("state").isin("PENDING", "SLEEPING") & (F.col("available_at") <= NOW()))


def _requests(spark, d):
    k = F.col("id")
    return S.tasks(spark, d).where("state = 'PENDING'").select("queue", F.concat(F.lit("s"), (k % 4).cast("string")).alias("slot_key"), k.alias("run_id"), k.alias("ord"), (1000 + 500 * (k % 4)).alias("interval_ms"), F.timestamp_add("SECOND", (k % 7200).cast("int"), NOW()).alias("available_at"))


def _cursors(spark, d):
    return S.queues(spark, d).select("queue", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("slot_key")).withColumn("next_slot_at", F.timestamp_add("MINUTE", (F.length("queue") * 3 - 20).cast("int"), NOW()))


def _failures(spark, d):
    k = F.col("task_id")
    return S.runs(spark, d).where("state = 'FAILED'").select(
        k.alias("id"), "attempt", (k % 13 == 0).alias("non_retryable"), F.when(k % 7 == 0, "Timeout").when(k % 7 == 1, "BadInput").otherwise("Io").alias("error_type"), F.when(k % 11 == 0, F.timestamp_add("SECOND", (k % 30).cast("int"), NOW())).alias("deadline_at"),
        F.lit(4).alias("max_attempts"), F.when(k % 17 == 0, F.lit(90).cast("long")).alias("retry_after_s"),
    )


def _keyed(spark, d, incoming):
    k = F.col("id")
    return S.tasks(spark, d).where((k % 2 == 1) if incoming else (k % 2 == 0)).select("id", "queue", F.concat(F.lit("k"), F.floor(k / 3).cast("string")).alias("key"))


def _sketch(spark, d):
    """An empty sketch, and the completed tasks that were served."""
    served = S.tasks(spark, d).where("state = 'COMPLETED'")
    return served.limit(0).select("queue", F.lit(0).alias("cell"), F.lit(0.0).alias("value")), served


def _sketch_pass(spark, d):
    """Pass values after all completed tasks were served, once through the sketch."""
    empty, served = _sketch(spark, d)
    return D.fairness_pass(D.fairness_advance(empty, served), served)


def _continued(spark, d):
    """Tasks, a twelfth of them continued as new after they were created long before they ended."""
    some = (F.col("state") == "COMPLETED") & (F.col("id") % 12 == 6)
    tasks = S.tasks(spark, d).withColumn("state", F.when(some, "CONTINUED_AS_NEW").otherwise(F.col("state")))
    late = F.timestamp_add("DAY", (F.col("id") % 700).cast("int"), F.col("completed_at"))
    return tasks.withColumn("completed_at", F.when(F.col("state") == "CONTINUED_AS_NEW", late).otherwise(F.col("completed_at")))


def _below(condition: str) -> str:
    return f"""WITH RECURSIVE {T}, below(root_id, id, depth, follow) AS (
    SELECT t.id, t.id, 0, true FROM tasks t WHERE {condition} UNION ALL
    SELECT b.root_id, t.id, b.depth + 1, t.parent_close_policy IS NULL OR t.parent_close_policy = 'TERMINATE' FROM below b JOIN tasks t ON t.parent_id = b.id WHERE b.follow)"""


_ALL_BELOW = f"""WITH RECURSIVE {T}, below(id, depth) AS (SELECT id, 0 FROM tasks WHERE id = 3 UNION ALL SELECT t.id, b.depth + 1 FROM below b JOIN tasks t ON t.parent_id = b.id),
d AS (SELECT t.id, t.state, t.created_at, b.depth FROM below b JOIN tasks t USING (id) WHERE b.depth > 0)"""

def _plans(spark, d, where, k):
    """Schedules to be merged: a next time, and an end for some."""
    days = lambda n: F.timestamp_add("DAY", n, F.col("created_at"))
    ends = F.when((F.col("id") + k) % 5 < 3, days(F.lit(60 + k)))
    return S.tasks(spark, d).where(where).select("id", days(((F.col("id") * 7 + k) % 30).cast("int")).alias("next_run_at"), ends.alias("ends_at"))


QUERIES = {
    "claim": (
        lambda s, d: D.claim(candidates(s, d), passes(s, d), NOW(), worker_id=3, limit=100).select("pos", "id", "queue", "priority", "pass"),
        f"""WITH {T}, {CAND_SQL}, {PASS_SQL}, {FRONT_SQL} SELECT row_number() OVER (ORDER BY priority, coalesce(pass, 0), CASE WHEN worker_id = 3 THEN 0 ELSE 1 END, available_at, id) AS pos, id, queue, priority, coalesce(pass, 0) AS pass
        FROM front LEFT JOIN passes USING (namespace_id, queue, fairness_key)
        WHERE (deadline_at IS NULL OR deadline_at > {N}) AND task_state NOT IN ('CANCELLED', 'FAILED', 'COMPLETED') QUALIFY pos <= 100""",
    ),
    "claim_frontier": (lambda s, d: D.frontier(_due(s, d)).select("id", "queue", "fairness_key"), f"WITH {T}, {CAND_SQL}, {FRONT_SQL} SELECT id, queue, fairness_key FROM front"),
    "fairness_pass": (
        lambda s, d: _sketch_pass(s, d).withColumn("pass", F.round("pass", 6)),
        f"""WITH {T}, v AS (SELECT queue, fairness_key, fairness_weight FROM tasks WHERE state = 'COMPLETED' AND fairness_key IS NOT NULL),
        c AS (SELECT v.*, r * 1024 + CAST('0x' || left(md5(r || ':' || fairness_key), 8) AS BIGINT) % 1024 AS cell FROM v, unnest([0, 1, 2, 3]) AS t(r)),
        s AS (SELECT queue, cell, sum(1000 / greatest(fairness_weight, 0.001)) AS value FROM c GROUP BY 1, 2)
        SELECT queue, fairness_key, round(min(value), 6) AS pass FROM (SELECT DISTINCT queue, fairness_key, cell FROM c) JOIN s USING (queue, cell) GROUP BY 1, 2""",
    ),
    "fairness_advance": (
        lambda s, d: D.fairness_advance(*_sketch(s, d), most=20_000.0).withColumn("value", F.round("value", 6)),
        f"""WITH {T}, v AS (SELECT queue, fairness_key, fairness_weight FROM tasks WHERE state = 'COMPLETED' AND fairness_key IS NOT NULL),
        c AS (SELECT v.*, r * 1024 + CAST('0x' || left(md5(r || ':' || fairness_key), 8) AS BIGINT) % 1024 AS cell FROM v, unnest([0, 1, 2, 3]) AS t(r)),
        s AS (SELECT queue, CAST(cell AS INTEGER) AS cell, sum(1000 / greatest(fairness_weight, 0.001)) AS value FROM c GROUP BY 1, 2),
        o AS (SELECT queue, max(value) AS top, min(value) FILTER (value > 0) AS low FROM s GROUP BY 1)
        SELECT queue, cell, round(CASE WHEN top > 20000 THEN greatest(value - low, 0) ELSE value END, 6) AS value FROM s JOIN o USING (queue)""",
    ),
    "rate_limit_slots": (
        lambda s, d: D.rate_limit_slots(_requests(s, d), _cursors(s, d), NOW()),
        f"""WITH {T}, q AS (SELECT queue, 's' || (id % 4) AS slot_key, id AS run_id, 1000 + 500 * (id % 4) AS interval_ms, {N} + to_seconds(id % 7200) AS available_at,
            row_number() OVER (PARTITION BY queue, id % 4 ORDER BY id) - 1 AS rank, count(*) OVER (PARTITION BY queue, id % 4) AS cnt FROM tasks WHERE state = 'PENDING'),
        c AS (SELECT n_name AS queue, s AS slot_key, {N} + to_minutes(length(n_name) * 3 - 20) AS next_slot_at FROM nation, unnest(['s0', 's1']) AS t(s)),
        b AS (SELECT q.*, greatest(coalesce(next_slot_at, {N}), {N}) AS base FROM q LEFT JOIN c USING (queue, slot_key))
        SELECT queue, slot_key, run_id, greatest(available_at, base + to_milliseconds(rank * interval_ms)) AS available_at, base + to_milliseconds(cnt * interval_ms) AS "cursor" FROM b""",
    ),
    "cancel_cascade": (
        lambda s, d: D.cancel_cascade(S.tasks(s, d), S.tasks(s, d).where("parent_id is null and state = 'CANCELLED'")),
        _below("parent_id IS NULL AND state = 'CANCELLED'")
        + """, a AS (SELECT b.root_id, b.id, b.depth, t.state, CASE WHEN parent_close_policy IS NULL OR parent_close_policy = 'TERMINATE' THEN 'TERMINATE' WHEN parent_close_policy = 'REQUEST_CANCEL' AND kind = 'WORKFLOW' THEN 'REQUEST_CANCEL' END AS action
        FROM below b JOIN tasks t USING (id) WHERE b.depth > 0) SELECT root_id, id, depth, action FROM a WHERE state IN ('PENDING', 'RUNNING', 'SLEEPING', 'WAITING') AND action IS NOT NULL""",
    ),
    "reset_children_failed_only": (lambda s, d: D.reset_children(S.tasks(s, d), 3), _ALL_BELOW + " SELECT * FROM d WHERE state IN ('FAILED', 'CANCELLED')"),
    "reset_children_dependents": (
        lambda s, d: D.reset_children(S.tasks(s, d), 3, "failed_and_dependents"),
        _ALL_BELOW + " SELECT * FROM d WHERE created_at >= (SELECT min(created_at) FROM d WHERE state IN ('FAILED', 'CANCELLED'))",
    ),
    "reset_children_all": (lambda s, d: D.reset_children(S.tasks(s, d), 3, "all"), _ALL_BELOW + " SELECT * FROM d"),
    "wake_completed_waiting": (
        lambda s, d: D.wake_waiting(S.tasks(s, d)),
        f"WITH {T} SELECT id, queue FROM tasks p WHERE state = 'WAITING' AND EXISTS (SELECT 1 FROM tasks c WHERE c.parent_id = p.id AND c.state IN ('COMPLETED', 'FAILED', 'CANCELLED', 'CONTINUED_AS_NEW'))",
    ),
    "all_children_done": (
        lambda s, d: D.children_done(S.tasks(s, d)),
        f"WITH {T} SELECT parent_id, count(*) AS n, count(*) FILTER (state = 'COMPLETED') AS done, count(*) = count(*) FILTER (state = 'COMPLETED') AS all_done FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1",
    ),
    "expired_leases": (
        lambda s, d: D.expired_leases(S.runs(s, d), NOW()).select("pos", "task_id", "attempt", "lease_expires_at"),
        f"WITH {R} SELECT row_number() OVER (ORDER BY lease_expires_at, task_id, attempt) AS pos, task_id, attempt, lease_expires_at FROM runs WHERE state = 'RUNNING' AND lease_expires_at <= {N} QUALIFY pos <= 50",
    ),
    "start_timeouts": (
        lambda s, d: D.start_timeouts(candidates(s, d), NOW()).select("id"),
        f"WITH {T}, {CAND_SQL} SELECT id FROM cand WHERE state IN ('PENDING', 'SLEEPING') AND kind = 'ACTIVITY' AND start_timeout_s IS NOT NULL AND available_at + to_seconds(start_timeout_s) <= {N}",
    ),
    "retry_decision": (
        lambda s, d: D.retry_decision(_failures(s, d), NOW(), fatal=("BadInput",)),
        f"""WITH {R}, f AS (SELECT task_id AS id, attempt, task_id % 13 = 0 AS non_retryable, task_id % 7 = 1 AS fatal, CASE WHEN task_id % 11 = 0 THEN {N} + to_seconds(task_id % 30) END AS deadline_at,
            CASE WHEN task_id % 17 = 0 THEN 90 ELSE CAST(floor(least(2.0 * pow(2.0, greatest(attempt - 1, 0)), 300.0)) AS BIGINT) END AS delay FROM runs WHERE state = 'FAILED'),
        w AS (SELECT *, CASE WHEN non_retryable THEN 'NON_RETRYABLE' WHEN fatal THEN 'ERROR_TYPE' WHEN deadline_at <= {N} + to_seconds(delay) THEN 'DEADLINE' WHEN attempt >= 4 THEN 'MAX_ATTEMPTS' ELSE 'RETRY' END AS decision FROM f)
        SELECT id, attempt, decision, CASE WHEN decision = 'RETRY' THEN delay END AS delay_s, CASE WHEN decision = 'RETRY' THEN {N} + to_seconds(delay) END AS available_at FROM w""",
    ),
    "prune_tasks": (
        lambda s, d: D.prunable_tasks(_continued(s, d), NOW(), days=365),
        f"""WITH {T}, t AS (SELECT * REPLACE (CASE WHEN state = 'COMPLETED' AND id % 12 = 6 THEN 'CONTINUED_AS_NEW' ELSE state END AS state,
            CASE WHEN state = 'COMPLETED' AND id % 12 = 6 THEN completed_at + to_days(CAST(id % 700 AS INTEGER)) ELSE completed_at END AS completed_at) FROM tasks),
        e AS (SELECT *, CASE state WHEN 'FAILED' THEN created_at WHEN 'CANCELLED' THEN cancelled_at ELSE completed_at END AS ended_at FROM t WHERE state IN ('COMPLETED', 'FAILED', 'CANCELLED', 'CONTINUED_AS_NEW'))
        SELECT id, state, ended_at FROM e WHERE ended_at < {N} - INTERVAL 365 DAY AND NOT EXISTS (SELECT 1 FROM t p WHERE p.id = e.parent_id AND p.state IN ('PENDING', 'RUNNING', 'SLEEPING', 'WAITING'))""",
    ),
    "merge_schedules": (
        lambda s, d: D.merge_schedules(_plans(s, d, "id % 3 <> 0", 5), _plans(s, d, "id % 4 <> 0", 0)),
        f"""WITH {T}, s AS (SELECT id, created_at + to_days(CAST((id * 7 + k) % 30 AS INTEGER)) AS next_run_at, CASE WHEN (id + k) % 5 < 3 THEN created_at + to_days(60 + k) END AS ends_at, k FROM tasks, unnest([5, 0]) AS t(k)),
        o AS (SELECT * FROM s WHERE k = 5 AND id % 3 <> 0), n AS (SELECT * FROM s WHERE k = 0 AND id % 4 <> 0)
        SELECT coalesce(o.id, n.id) AS id, least(o.next_run_at, n.next_run_at) AS next_run_at, coalesce(n.ends_at, o.ends_at) AS ends_at FROM o FULL JOIN n ON o.id = n.id""",
    ),
    "namespaces_retention": (
        lambda s, d: D.namespaces_retention(S.queues(s, d).select("namespace_id", (F.length("queue") * 3).alias("retention_days"))),
        "SELECT min(length(n_name) * 3)::INTEGER AS retention_days FROM nation",
    ),
    "expired_months": (
        lambda s, d: D.expired_months(S.tasks(s, d).select(F.date_format("created_at", "yyyyMM").alias("month")).distinct(), NOW(), 12),
        f"WITH {T} SELECT DISTINCT strftime(created_at, '%Y%m') AS month FROM tasks WHERE date_trunc('month', created_at) < date_trunc('month', {N}) - INTERVAL 12 MONTH",
    ),
    "prune_events": (
        lambda s, d: D.prunable_events(S.events(s, d), S.as_of(S.EVENTS_AS_OF), days=20, limit=500).select("pos", "id"),
        f"WITH {E} SELECT row_number() OVER (ORDER BY created_at, id) AS pos, id FROM ev WHERE created_at < TIMESTAMP '{S.EVENTS_AS_OF}' - INTERVAL 20 DAY QUALIFY pos <= 500",
    ),
    "orphan_rows": (
        lambda s, d: D.orphan_rows(passes(s, d), S.queues(s, d).where("namespace_id <> 'ASIA'")),
        f"WITH {T}, {PASS_SQL} SELECT namespace_id, queue, fairness_key, pass FROM passes WHERE queue NOT IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')",
    ),
    "enqueue_dedup": (
        lambda s, d: D.enqueue_dedup(_keyed(s, d, False), _keyed(s, d, True)),
        f"""WITH {T}, k AS (SELECT id, queue, 'k' || (id // 3) AS key FROM tasks), f AS (SELECT queue, key, min(id) AS new_id FROM k WHERE id % 2 = 1 GROUP BY ALL), o AS (SELECT queue, key, min(id) AS old_id FROM k WHERE id % 2 = 0 GROUP BY ALL)
        SELECT k.id, k.queue, k.key, coalesce(old_id, new_id) AS kept_id, k.id = coalesce(old_id, new_id) AS created FROM k JOIN f USING (queue, key) LEFT JOIN o USING (queue, key) WHERE k.id % 2 = 1""",
    ),
    "complete_runs": (
        lambda s, d: D.complete_runs(S.runs(s, d), S.runs(s, d).where("task_id % 2 = 0").select("task_id", (F.col("attempt") - F.col("task_id") % 3 + 1).alias("attempt"))).select("task_id", "attempt", "state"),
        f"WITH {R} SELECT r.task_id, r.attempt, 'COMPLETED' AS state FROM runs r JOIN (SELECT task_id, attempt - task_id % 3 + 1 AS attempt FROM runs WHERE task_id % 2 = 0) x USING (task_id, attempt) WHERE r.state = 'RUNNING'",
    ),
    "merge_spans": (
        lambda s, d: D.merge_spans(*[S.runs(s, d).where(c).select(F.col("task_id").alias("id"), "attempt", "state", "started_at", "finished_at") for c in ("attempt = 2", "attempt = 3 and task_id % 4 <> 0")]),
        f"""WITH {R}, o AS (SELECT * FROM runs WHERE attempt = 2), n AS (SELECT * FROM runs WHERE attempt = 3 AND task_id % 4 <> 0)
        SELECT coalesce(o.task_id, n.task_id) AS id, greatest(o.attempt, n.attempt) AS attempt, coalesce(n.state, o.state) AS state, coalesce(n.started_at, o.started_at) AS started_at, coalesce(n.finished_at, o.finished_at) AS finished_at FROM o FULL JOIN n ON o.task_id = n.task_id""",
    ),
    "merge_checkpoints": (
        lambda s, d: D.merge_checkpoints(S.runs(s, d).select("task_id", (F.col("attempt") % 2).alias("seq"), "attempt", F.col("worker_id").alias("value"), F.col("started_at").alias("written_at"))),
        f"WITH {R} SELECT task_id, attempt % 2 AS seq, max(attempt) AS attempt, arg_max(worker_id, attempt) AS value FROM runs GROUP BY task_id, attempt % 2",
    ),
}
