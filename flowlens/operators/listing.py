"""Pages, top-k lists and lookups.

A page keeps ``limit`` rows behind a cursor under a total order: Spark plans it as a
top-k on each partition and one merge. Lists number their rows in ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.tables import first_by, ranked


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows where each given column equals its value; a None value asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def list_tasks(tasks: DataFrame, limit: int = 50, before: int | None = None, root_only: bool | None = None, **equal) -> DataFrame:
    """Tasks by id, newest first, before a cursor; ``more`` says whether a page follows. ``limit`` is held to 200."""
    limit = min(200, max(1, limit))
    rows = filtered(tasks, **equal)
    if root_only is not None:
        rows = rows.where(F.col("parent_id").isNull() == F.lit(root_only))
    if before is not None:
        rows = rows.where(F.col("id") < before)
    page = ranked(rows, limit + 1, F.desc("id"))
    more = F.max("pos").over(Window.partitionBy(F.lit(0))) > limit
    return page.withColumn("more", more).where(F.col("pos") <= limit)


def list_children(tasks: DataFrame, parent_id: int, limit: int = 50, before: int | None = None) -> DataFrame:
    return list_tasks(tasks, limit, before, parent_id=parent_id)


def list_events(events: DataFrame, limit: int = 50, before: Column | None = None, since: Column | None = None, **equal) -> DataFrame:
    """Events, newest first, before a time."""
    rows = filtered(events, **equal)
    rows = rows.where(F.col("created_at") < before) if before is not None else rows
    rows = rows.where(F.col("created_at") >= since) if since is not None else rows
    return ranked(rows, limit, F.desc("created_at"), F.desc("id"))


def list_schedules(schedules: DataFrame, limit: int = 50, after: tuple[str, str] | None = None) -> DataFrame:
    """Schedules by (queue, name) behind a pair of both."""
    if after is not None:
        schedules = schedules.where((F.col("queue") > after[0]) | ((F.col("queue") == after[0]) & (F.col("name") > after[1])))
    return ranked(schedules, limit, F.asc("queue"), F.asc("name"))


def list_runs(runs: DataFrame, task_id: int) -> DataFrame:
    """A task's attempts, last first."""
    rows = runs.where(F.col("task_id") == task_id)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("attempt"))).cast("long"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each task's last attempt, by one aggregate without a sort."""
    last = F.max_by(F.struct("state", "worker_id", "started_at", "finished_at"), "attempt").alias("r")
    return runs.groupBy("task_id").agg(F.max("attempt").alias("attempt"), last).select("task_id", "attempt", "r.state", "r.worker_id", "r.started_at", "r.finished_at")


def task_results(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Each ended task with how its last attempt ended; null for tasks without runs."""
    ended = tasks.where(F.col("state").isin("COMPLETED", "FAILED", "CANCELLED")).select("id", "state")
    last = latest_runs(runs).select(F.col("task_id").alias("id"), "attempt", F.col("state").alias("run_state"))
    return ended.join(last, "id", "left")


def worker_recent_runs(runs: DataFrame, worker_id: int, limit: int = 50) -> DataFrame:
    return ranked(runs.where(F.col("worker_id") == worker_id), limit, F.desc_nulls_last("started_at"), F.desc("task_id"), F.desc("attempt"))


def task_kinds(tasks: DataFrame) -> DataFrame:
    """One kind and queue for each task name, the least of both."""
    return tasks.groupBy("name").agg(F.min(F.struct("kind", "queue")).alias("k")).select("name", "k.kind", "k.queue")


def event_waiters(waits: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Who waits for an event, longest first."""
    return ranked(waits.where(F.col("event_name") == name), limit, F.asc("created_at"), F.asc("id"))


def latest_trigger(triggers: DataFrame) -> DataFrame:
    """The event that woke each task last."""
    return triggers.groupBy("task_id").agg(F.max(F.struct("triggered_at", "emission_id")).alias("t")).select("task_id", "t.triggered_at", "t.emission_id")


def latest_events(events: DataFrame) -> DataFrame:
    """The newest payload of each queue and event name."""
    return events.groupBy("queue", "name").agg(F.max_by("payload", F.struct("created_at", "id")).alias("payload"), F.max("created_at").alias("created_at"))


def due_schedules(schedules: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Active schedules whose next time has come, inside their window, soonest first."""
    rows = schedules.where(F.col("is_active") & (F.col("next_run_at") <= as_of) & (F.col("starts_at").isNull() | (F.col("starts_at") <= as_of)) & (F.col("ends_at").isNull() | (F.col("ends_at") > as_of)))
    return ranked(rows, limit, F.asc("next_run_at"), F.asc("id"))


def next_fire_time(schedules: DataFrame) -> DataFrame:
    return schedules.where("is_active").agg(F.min("next_run_at").alias("next_run_at"))


def schedule_runs(tasks: DataFrame, schedule_id: int, limit: int = 100) -> DataFrame:
    return ranked(tasks.where(F.col("schedule_id") == schedule_id), min(100, limit), F.desc("created_at"), F.desc("id"))


def completed_children(tasks: DataFrame, runs: DataFrame, parent_id: int) -> DataFrame:
    """A parent's ended child activities in order, with their last attempt and place in the parent's commands.

    The place is read from the child's key, ``<parent>:<place>``.
    """
    rows = tasks.where((F.col("parent_id") == parent_id) & F.col("state").isin("COMPLETED", "FAILED", "CANCELLED"))
    seq = F.try_element_at(F.split("key", ":"), F.lit(2)).try_cast("int")
    last = latest_runs(runs).select(F.col("task_id").alias("id"), "attempt")
    return rows.select("id", "state", seq.alias("seq")).join(last, "id", "left")


def next_seq(history: DataFrame) -> DataFrame:
    """The next number of each task's history."""
    return history.groupBy("task_id").agg((F.max("seq") + 1).alias("next_seq"))


def lookup(df: DataFrame, id: int, namespace_id: str | None = None, key: str = "id") -> DataFrame:
    """The row of an id, in a namespace if one is named; the filter reaches the scan."""
    return filtered(df, **{key: id, "namespace_id": namespace_id})


def workflow_by_key(tasks: DataFrame, runs: DataFrame, queue: str, key: str, namespace_id: str | None = None) -> DataFrame:
    """The task that an idempotency key names in a queue, with its last attempt; none if it has no run."""
    task = filtered(tasks, namespace_id=namespace_id, queue=queue, key=key).select(F.col("id").alias("task_id"))
    return ranked(runs.select("task_id", "attempt").join(F.broadcast(task), "task_id"), 1, F.desc("attempt"), F.desc("task_id")).drop("pos")


def list_history(history: DataFrame, task_id: int, kinds: tuple[str, ...]) -> DataFrame:
    """A task's history in order, without kinds that are not known."""
    rows = history.where((F.col("task_id") == task_id) & F.col("kind").isin(*kinds))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("seq")).cast("long"))


def list_checkpoints(checkpoints: DataFrame, task_id: int, attempt: int) -> DataFrame:
    """A run's checkpoints in order of time."""
    rows = checkpoints.where((F.col("task_id") == task_id) & (F.col("attempt") == attempt))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("task_id").orderBy("written_at", "seq")).cast("long"))


def backfills_running(backfills: DataFrame, namespace_id: str | None = None, limit: int = 50) -> DataFrame:
    """Running backfills, oldest first."""
    return ranked(filtered(backfills, namespace_id=namespace_id, status="RUNNING"), limit, F.asc("created_at"), F.asc("id"))


def backfills_for_queue(backfills: DataFrame, queue: str, name: str, namespace_id: str | None = None, limit: int = 20) -> DataFrame:
    """A task's backfills in a queue, newest first."""
    return ranked(filtered(backfills, namespace_id=namespace_id, queue=queue, name=name), limit, F.desc("created_at"), F.desc("id"))


def busiest(timings: DataFrame, seconds: float, limit: int = 20) -> DataFrame:
    """The ``limit`` names with the most timings (name, n), and their rate."""
    return ranked(timings, limit, F.desc("n"), F.asc("name")).withColumn("rate", F.col("n") / F.lit(float(seconds)))


def state_totals(counts: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Counts of each state over all queues."""
    return counts.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in states])


def children_by_outcome(tasks: DataFrame) -> DataFrame:
    """Each parent's completed and failed children, as sorted lists: a parent's children are few."""
    pick = lambda state: F.sort_array(F.collect_list(F.when(F.col("state") == state, F.col("id"))))
    rows = tasks.where(F.col("parent_id").isNotNull())
    return rows.groupBy("parent_id").agg(pick("COMPLETED").alias("completed"), pick("FAILED").alias("failed"))


def with_ordinality(df: DataFrame, array: str, name: str, number: str = "n") -> DataFrame:
    """A row for each element of an array column, numbered from 1; rows with none, or null, give none."""
    others = [c for c in df.columns if c != array]
    rows = df.select(*others, F.posexplode(array).alias("_at", name))
    return rows.select(*others, name, (F.col("_at") + 1).cast("long").alias(number))


def unsatisfied_waits(waits: DataFrame, received: DataFrame) -> DataFrame:
    """Waits that are left after those whose task has received the event were dropped."""
    return waits.join(received.select("task_id", "name").distinct(), ["task_id", "name"], "left_anti")


def predicate(path: str, value: Column) -> Column:
    """The JSON object that holds ``value`` at a dotted path: a predicate of one leaf."""
    names = path.split(".")
    shown = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    json_value = F.regexp_extract(shown, r'(?s)^\{"v":(.*)\}$', 1)
    quoted = [n.replace("\\", "\\\\").replace('"', '\\"') for n in names]
    return F.concat(F.lit("".join(f'{{"{n}":' for n in quoted)), json_value, F.lit("}" * len(names)))
