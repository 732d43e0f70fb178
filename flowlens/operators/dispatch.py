"""Set-based dispatch: which rows are claimed, delayed, cancelled, retried or pruned, and with what new values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.columns import LIVE, TERMINAL, retry_delay
from flowlens.functions.tables import closure, first_by, ranked

#: Rows and cells of the fairness sketch.
HASHES, CELLS = 4, 1024


def _scope(df: DataFrame) -> list[str]:
    """Queues are told apart by namespace where the rows have one."""
    return [c for c in ("namespace_id", "queue") if c in df.columns]


def frontier(candidates: DataFrame) -> DataFrame:
    """The first candidate of each fairness key of a queue, and all without one."""
    keyed, free = candidates.where("fairness_key is not null"), candidates.where("fairness_key is null")
    order = F.asc("priority"), F.asc("available_at"), F.asc("id")
    return first_by(keyed, [*_scope(candidates), "fairness_key"], *order).unionByName(free)


def claim(candidates: DataFrame, passes: DataFrame, as_of: Column, worker_id: int | None = None, limit: int = 10) -> DataFrame:
    """Up to ``limit`` runs to claim, in order.

    Of the due, waiting runs, a key's first one competes; it is claimed only if its
    task is neither over (``task_state``, where given) nor past its deadline, and
    blocks its key until then. The order is priority, the key's pass value,
    whether it ran on this worker before, time and id.
    """
    due = candidates.where(F.col("state").isin("PENDING", "SLEEPING") & (F.col("available_at") <= as_of))
    first = frontier(due).where(F.col("deadline_at").isNull() | (F.col("deadline_at") > as_of))
    if "task_state" in first.columns:
        first = first.where(~F.col("task_state").isin("CANCELLED", "FAILED", "COMPLETED"))
    keys = [*_scope(passes), "fairness_key"]
    first = first.join(passes, keys, "left").withColumn("pass", F.coalesce("pass", F.lit(0.0)))
    sticky = F.when(F.col("worker_id") == F.lit(worker_id), 0).otherwise(1)
    return ranked(first, limit, F.asc("priority"), F.asc("pass"), sticky.asc(), F.asc("available_at"), F.asc("id"))


def _cells(df: DataFrame) -> DataFrame:
    """A row for each of a key's cells, one in each row of the sketch, by the MD5 of row and key."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("r")
    digest = F.md5(F.concat(F.col("r").cast("string"), F.lit(":"), F.col("fairness_key")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return df.select("*", seeds).withColumn("cell", (F.col("r") * CELLS + F.pmod(number, F.lit(CELLS))).cast("int"))


def fairness_advance(sketch: DataFrame, served: DataFrame, step: float = 1000.0, most: float = 1e11) -> DataFrame:
    """The count-min sketch (queue, cell, value) after runs were served.

    Each adds step / max(weight, 0.001) to its key's cells. If a queue's largest cell
    passes ``most``, its least positive value is taken off all, down to 0.
    """
    added = _cells(served.where("fairness_key is not null")).select("queue", "cell", (F.lit(step) / F.greatest("fairness_weight", F.lit(0.001))).alias("value"))
    sums = sketch.select("queue", "cell", "value").unionByName(added).groupBy("queue", "cell").agg(F.sum("value").alias("value"))
    over = sums.groupBy("queue").agg(F.max("value").alias("_max"), F.min(F.when(F.col("value") > 0, F.col("value"))).alias("_min"))
    rebased = F.when(F.col("_max") > most, F.greatest(F.col("value") - F.col("_min"), F.lit(0.0))).otherwise(F.col("value"))
    return sums.join(over, "queue").select("queue", "cell", rebased.alias("value"))


def fairness_pass(sketch: DataFrame, keys: DataFrame) -> DataFrame:
    """(queue, fairness_key, pass): the least of a key's cells, 0 for a cell that nothing was added to."""
    cells = _cells(keys.where("fairness_key is not null").select("queue", "fairness_key").distinct())
    return cells.join(sketch, ["queue", "cell"], "left").groupBy("queue", "fairness_key").agg(F.min(F.coalesce("value", F.lit(0.0))).alias("pass"))


def rate_limit_slots(requests: DataFrame, cursors: DataFrame, as_of: Column) -> DataFrame:
    """When each request of a bucket (queue, slot_key) may start, and the bucket's new cursor.

    The base is the later of cursor and now; the k-th request, by ``ord``, starts k
    intervals after it, and never before it was due.
    """
    bucket = Window.partitionBy("queue", "slot_key")
    rows = requests.withColumns({"rank": F.row_number().over(bucket.orderBy("ord")) - 1, "cnt": F.count("*").over(bucket)})
    rows = rows.join(cursors, ["queue", "slot_key"], "left").withColumn("base", F.greatest(F.coalesce("next_slot_at", as_of), as_of))
    step = lambda n: F.timestamp_add("MICROSECOND", n * F.col("interval_ms") * 1000, F.col("base"))
    return rows.select("queue", "slot_key", "run_id", F.greatest("available_at", step(F.col("rank"))).alias("available_at"), step(F.col("cnt")).alias("cursor"))


def slot_interval(period_ms: Column, limit: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(period_ms / limit)).cast("long")


def cancel_cascade(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """What becomes of the live tasks below cancelled ones: TERMINATE or REQUEST_CANCEL.

    The cascade goes on only below tasks whose policy is TERMINATE or null. A
    request reaches workflows only; abandoned and waiting policies leave a task alone.
    """
    ends = F.col("parent_close_policy").isNull() | (F.col("parent_close_policy") == "TERMINATE")
    slim = tasks.select("id", "parent_id", "kind", "state", "parent_close_policy")
    below = closure(slim, roots.select(F.col("id").alias("root_id"), "id"), ends)
    action = F.when(ends, "TERMINATE").when((F.col("parent_close_policy") == "REQUEST_CANCEL") & (F.col("kind") == "WORKFLOW"), "REQUEST_CANCEL")
    return below.where(F.col("state").isin(*LIVE)).select("root_id", "id", "depth", action.alias("action")).where("action is not null")


def reset_children(tasks: DataFrame, root_id: int, mode: str = "failed_only") -> DataFrame:
    """Descendants that a retry of ``root_id`` resets: failed ones, those and all from the first failure on, or all."""
    slim = tasks.select("id", "parent_id", "state", "created_at")
    roots = slim.where(F.col("id") == root_id).select(F.col("id").alias("root_id"), "id")
    below = closure(slim, roots).select("id", "state", "created_at", "depth")
    failed = F.col("state").isin("FAILED", "CANCELLED")
    if mode == "failed_only":
        return below.where(failed)
    if mode == "failed_and_dependents":
        first = below.where(failed).agg(F.min("created_at").alias("_first"))
        return below.join(F.broadcast(first), F.col("created_at") >= F.col("_first")).drop("_first")
    return below


def wake_waiting(tasks: DataFrame) -> DataFrame:
    """Waiting tasks with a child that has ended."""
    ended = tasks.where(F.col("state").isin(*TERMINAL) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    return tasks.where("state = 'WAITING'").select("id", "queue").join(ended, "id", "left_semi")


def children_done(tasks: DataFrame) -> DataFrame:
    """Parents by whether all their children have completed."""
    found = tasks.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "COMPLETED").alias("done"))
    return found.select("parent_id", "n", "done", (F.col("n") == F.col("done")).alias("all_done"))


def expired_leases(runs: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    return ranked(runs.where((F.col("state") == "RUNNING") & (F.col("lease_expires_at") <= as_of)), limit, F.asc("lease_expires_at"), F.asc("task_id"), F.asc("attempt"))


def start_timeouts(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Activities that nobody started within their time."""
    late = F.timestamp_add("SECOND", F.col("start_timeout_s"), F.col("available_at")) <= as_of
    return candidates.where(F.col("state").isin("PENDING", "SLEEPING") & (F.col("kind") == "ACTIVITY") & F.col("start_timeout_s").isNotNull() & late)


def retry_decision(failures: DataFrame, as_of: Column, fatal: tuple[str, ...] = ()) -> DataFrame:
    """Whether each failed attempt is retried, why not, and when.

    Reasons come in order: marked as final, a fatal error type, the deadline, the
    number of attempts. A delay that the error asks for goes before the strategy's.
    """
    delay = F.coalesce("retry_after_s", retry_delay(F.col("attempt")))
    at = F.timestamp_add("SECOND", delay, as_of)
    why = F.when(F.coalesce("non_retryable", F.lit(False)), "NON_RETRYABLE").when(F.col("error_type").isin(*fatal) if fatal else F.lit(False), "ERROR_TYPE").when(F.col("deadline_at") <= at, "DEADLINE").when(F.col("attempt") >= F.col("max_attempts"), "MAX_ATTEMPTS").otherwise("RETRY")
    return failures.select("id", "attempt", why.alias("decision"), F.when(why == "RETRY", delay).alias("delay_s"), F.when(why == "RETRY", at).alias("available_at"))


def prunable_tasks(tasks: DataFrame, as_of: Column, days: int = 30, limit: int | None = None) -> DataFrame:
    """Ended tasks older than ``days``, whose parent is none, gone or ended.

    Completed and continued tasks are dated by their completion, cancelled ones by
    their cancellation, failed ones by their creation; without that date they stay.
    """
    cut = as_of - F.expr(f"INTERVAL {days} DAYS")
    at = F.when(F.col("state").isin("COMPLETED", "CONTINUED_AS_NEW"), F.col("completed_at")).when(F.col("state") == "CANCELLED", F.col("cancelled_at")).otherwise(F.col("created_at"))
    rows = tasks.where(F.col("state").isin(*TERMINAL) & (at < cut)).select("id", "parent_id", "state", at.alias("ended_at"))
    live = tasks.where(~F.col("state").isin(*TERMINAL)).select(F.col("id").alias("parent_id"))
    found = rows.join(live, "parent_id", "left_anti").select("id", "state", "ended_at")
    return found if limit is None else ranked(found, limit, F.asc("ended_at"), F.asc("id"))


def prunable_events(events: DataFrame, as_of: Column, days: int = 30, limit: int = 1000) -> DataFrame:
    return ranked(events.where(F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS")), limit, F.asc("created_at"), F.asc("id"))


def orphan_rows(rows: DataFrame, queues: DataFrame) -> DataFrame:
    """Rows of queues that are no more."""
    return rows.join(queues.select("queue").distinct(), "queue", "left_anti")


def enqueue_dedup(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The row that stands for each incoming one under (queue, key): an existing one, or the first new one."""
    keys = ["queue", "key"]
    first = first_by(incoming, keys, F.asc("id")).select(*keys, F.col("id").alias("new_id"))
    old = existing.groupBy(*keys).agg(F.min("id").alias("old_id"))
    met = first.join(old, keys, "left").select(*keys, F.coalesce("old_id", "new_id").alias("kept_id"))
    return incoming.join(met, keys).select("id", *keys, "kept_id", (F.col("id") == F.col("kept_id")).alias("created"))


def complete_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """Runs that a completion applies to: still running, at the version that the worker saw."""
    return runs.where("state = 'RUNNING'").join(done.select("task_id", "attempt"), ["task_id", "attempt"]).withColumn("state", F.lit("COMPLETED"))


def merge_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spans after an upsert: the greater attempt, and for the rest the new value where there is one."""
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("attempt", "state", "started_at", "finished_at")])
    both = old.join(n, "id", "full")
    return both.select("id", F.greatest("attempt", "n_attempt").alias("attempt"), *[F.coalesce(f"n_{c}", c).alias(c) for c in ("state", "started_at", "finished_at")])


def merge_schedules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Schedules after an upsert: the earlier next time that is known; an end stays unless a new one is given."""
    both = old.join(new.select("id", F.col("next_run_at").alias("n_next"), F.col("ends_at").alias("n_ends")), "id", "full")
    return both.select("id", F.least("next_run_at", "n_next").alias("next_run_at"), F.coalesce("n_ends", "ends_at").alias("ends_at"))


def merge_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The value that holds for each (task_id, seq): that of the highest attempt, the latest write of it."""
    return checkpoints.groupBy("task_id", "seq").agg(F.max("attempt").alias("attempt"), F.max_by("value", F.struct("attempt", "written_at")).alias("value"))


def namespaces_retention(namespaces: DataFrame) -> DataFrame:
    return namespaces.agg(F.min("retention_days").alias("retention_days"))


def expired_months(months: DataFrame, as_of: Column, keep_months: int) -> DataFrame:
    """Monthly partitions before the oldest that is kept."""
    return months.where(F.to_date("month", "yyyyMM") < F.add_months(F.trunc(as_of.cast("date"), "month"), -keep_months))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
