"""The task data model as views of the plain tables, and the same views as SQL.

Orders stand for tasks, line items for runs, events for events, nations for queues
and regions for namespaces. Each view exists as a DataFrame and as a common table
expression, so that a query and the SQL it is held against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The "now" of task queries and of event queries.
TASKS_AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str):
    return F.lit(text).cast("timestamp_ntz")


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue per nation: namespace_id, queue."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("namespace_id"), F.col("n_name").alias("queue"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per order. Its parent, if any, has a lesser id: the tasks form trees."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    live = F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "RUNNING").when(k % 4 == 2, "SLEEPING").otherwise("WAITING")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when((F.col("o_orderstatus") == "P") & (k % 5 == 0), "CANCELLED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise(live)
    policy = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "TERMINATE").when(k % 4 == 2, "ABANDON").otherwise("REQUEST_CANCEL")
    parent = F.when(k % 3 != 0, F.floor(k / 4)).cast("long")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(
        k.alias("id"), F.col("r_name").alias("namespace_id"), F.col("n_name").alias("queue"), F.col("o_orderpriority").alias("name"), state.alias("state"),
        F.when((k % 3 == 0) | (k % 2 == 1), "WORKFLOW").otherwise("ACTIVITY").alias("kind"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        parent.alias("parent_id"), policy.alias("parent_close_policy"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 10 != 0, F.concat(F.lit("t"), (k % 50).cast("string"))).alias("fairness_key"), (1 + k % 3).cast("double").alias("fairness_weight"),
        F.when(parent.isNull() & (k % 7 == 0), k % 20).alias("schedule_id"), F.when(parent.isNull() & (k % 11 == 0), k % 5).alias("backfill_id"),
    )
    return rows.withColumns({
        "completed_at": F.when(F.col("state") == "COMPLETED", F.timestamp_add("HOUR", (F.col("id") % 97).cast("int"), F.col("created_at"))),
        "cancelled_at": F.when(F.col("state") == "CANCELLED", F.timestamp_add("HOUR", (F.col("id") % 13).cast("int"), F.col("created_at"))),
    })


def runs(spark: SparkSession, sf_dir: str, with_tasks: DataFrame | None = None) -> DataFrame:
    """One run per line item: an attempt of its order's task, on its supplier's worker."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    attempt = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", attempt.alias("attempt"))
    state = F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "COMPLETED").when(F.col("l_linestatus") == "O", "RUNNING").otherwise("COMPLETED")
    task = (with_tasks if with_tasks is not None else tasks(spark, sf_dir)).select(F.col("id").alias("task_id"), "namespace_id", "queue", "name", "kind", "priority", "created_at")
    rows = items.join(task, F.col("l_orderkey") == F.col("task_id"))
    rows = rows.select(F.col("l_orderkey").alias("task_id"), "attempt", "namespace_id", "queue", "name", "kind", "priority", "created_at", F.col("l_suppkey").alias("worker_id"), state.alias("state"), F.timestamp_add("HOUR", F.col("attempt").cast("int"), F.col("created_at")).alias("started_at"), F.col("l_quantity").cast("int").alias("minutes"))
    return rows.withColumns({"finished_at": F.when(F.col("state") != "RUNNING", F.timestamp_add("MINUTE", F.col("minutes"), F.col("started_at"))), "lease_expires_at": F.timestamp_add("MINUTE", F.col("minutes") * 3, F.col("started_at"))})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named events with a JSON payload."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("queue"), F.col("event_type").alias("name"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "user_id", "value"
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by county and site: the events with their values."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("county"), F.col("user_id").alias("site"), F.col("value").alias("depth"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 3 == 0, "Good").when(F.col("event_id") % 3 == 1, "Fair").alias("quality"))


TASKS_SQL = """tasks AS (
    SELECT *, CASE WHEN state = 'COMPLETED' THEN created_at + to_hours(id % 97) END AS completed_at, CASE WHEN state = 'CANCELLED' THEN created_at + to_hours(id % 13) END AS cancelled_at
    FROM (SELECT o_orderkey AS id, r_name AS namespace_id, n_name AS queue, o_orderpriority AS name,
        CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'P' THEN 'FAILED'
             WHEN o_orderkey % 4 = 0 THEN 'PENDING' WHEN o_orderkey % 4 = 1 THEN 'RUNNING' WHEN o_orderkey % 4 = 2 THEN 'SLEEPING' ELSE 'WAITING' END AS state,
        CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN 'WORKFLOW' ELSE 'ACTIVITY' END AS kind, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 4 END AS parent_id,
        CASE o_orderkey % 4 WHEN 1 THEN 'TERMINATE' WHEN 2 THEN 'ABANDON' WHEN 3 THEN 'REQUEST_CANCEL' END AS parent_close_policy, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 10 <> 0 THEN 't' || (o_orderkey % 50) END AS fairness_key, CAST(1 + o_orderkey % 3 AS DOUBLE) AS fairness_weight,
        CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN o_orderkey % 20 END AS schedule_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 THEN o_orderkey % 5 END AS backfill_id
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

QUEUES_SQL = "queues AS (SELECT r_name AS namespace_id, n_name AS queue FROM nation JOIN region ON n_regionkey = r_regionkey)"

RUNS_SQL = """runs AS (
    SELECT *, CASE WHEN state <> 'RUNNING' THEN started_at + to_minutes(minutes) END AS finished_at, started_at + to_minutes(minutes * 3) AS lease_expires_at
    FROM (SELECT id AS task_id, attempt, namespace_id, queue, name, kind, priority, created_at, l_suppkey AS worker_id,
        CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'A' THEN 'COMPLETED' WHEN l_linestatus = 'O' THEN 'RUNNING' ELSE 'COMPLETED' END AS state,
        created_at + to_hours(attempt) AS started_at, CAST(l_quantity AS INTEGER) AS minutes
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS attempt FROM lineitem)
    JOIN tasks ON l_orderkey = id))"""

EVENTS_SQL = "ev AS (SELECT event_id AS id, 'q' || (user_id % 20) AS queue, event_type AS name, props AS payload, ts AS created_at, user_id, value FROM events)"

MEASUREMENTS_SQL = "measurements AS (SELECT event_type AS county, user_id AS site, value AS depth, CAST(ts AS DATE) AS day, CASE event_id % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' END AS quality FROM events)"
