"""Spans from history, trace trees, and events that wake those who wait for them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from flowlens.functions.columns import millis_between
from flowlens.functions.tables import closure, cut_lineage

#: The span kinds that have a start and an end, and those that are points.
PAIRED, POINTS = ("SLEEP", "WAIT", "CONDITION"), ("SIGNAL", "UPDATE", "EMIT")
_EVENT = "struct<t: timestamp_ntz, e: bigint>"


def history_spans(history: DataFrame) -> DataFrame:
    """Spans of a history (task_id, seq, kind, phase, name, at, timer_seq); phase is START, END, TIMEOUT or POINT.

    A wait has a slot by its name, a sleep by its ``timer_seq`` where it has one (the
    column may be left out): an end closes the start that its slot holds, and a start
    that another one of its slot follows is lost. Other sleeps, and conditions, pair in
    order: an end closes the oldest open start of its task and kind. A sleep's end
    whose slot is empty does so too. Ends that find nothing open are dropped; starts
    that nothing closes are RUNNING.
    """
    if "timer_seq" not in history.columns:
        history = history.withColumn("timer_seq", F.lit(None).cast("long"))
    kind, at, is_start, code = F.col("kind"), F.col("at"), F.col("phase") == "START", lambda c: F.when(F.col(c) == "TIMEOUT", 1).when(F.col(c).isNotNull(), 0)
    slot = F.when(kind == "WAIT", F.coalesce("name", F.lit(""))).when(kind == "SLEEP", F.col("timer_seq").cast("string"))
    rows = history.where(kind.isin(*PAIRED, *POINTS)).select("task_id", "seq", "kind", "phase", "name", "at", slot.alias("_slot"))
    # the history is gone through once: all windows, and the groups, lie within a task and kind
    in_slot = Window.partitionBy("task_id", "kind", "_slot").orderBy("seq")
    rows = rows.withColumns({"_before": F.lag("phase").over(in_slot), "_after": F.lead("phase").over(in_slot), "_after_at": F.lead("at").over(in_slot)})
    held, loose = F.col("_slot").isNotNull(), (kind == "SLEEP") & ~is_start & (F.col("_before").isNull() | (F.col("_before") != "START"))
    closed = held & is_start & (F.col("_after").isNull() | (F.col("_after") != "START"))
    line = F.when(held, loose).otherwise(kind.isin("SLEEP", "CONDITION"))
    rows = rows.withColumns({"_closed": F.coalesce(closed, F.lit(False)), "_line": F.coalesce(line, F.lit(False))})
    # open starts are the running sum of starts less ends, less what it fell below zero: an end that makes a new low finds none
    by_seq = Window.partitionBy("task_id", "kind").orderBy("seq")
    so_far = by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_sum", F.sum(F.when(F.col("_line"), F.when(is_start, 1).otherwise(-1))).over(by_seq))
    low = F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("_line"), F.col("_sum"))).over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = summed.withColumn("_low", low).withColumn("_fifo", F.col("_line") & (is_start | (F.col("_sum") >= F.col("_low"))))
    fifo, end = F.col("_fifo"), F.col("_fifo") & ~is_start
    nth = lambda when: F.count(F.when(when, 1)).over(so_far)
    numbered = found.withColumn("_k", F.when(end, nth(end)).when(fifo, nth(fifo & is_start)).otherwise(nth(F.lit(True))))
    point = kind.isin(*POINTS)
    name = F.when(kind == "WAIT", F.col("_slot")).when(point, F.coalesce("name", F.lower("kind"))).otherwise(F.lower("kind"))
    spans = numbered.where(F.col("_closed") | fifo | point).groupBy("task_id", "kind", "_fifo", "_k", name.alias("name")).agg(  # a start and its end have one number; others are alone
        F.min(F.when(~end, F.col("seq"))).alias("seq"), F.min(F.when(~end, at)).alias("started_at"),
        F.min(F.when(F.col("_closed"), F.col("_after_at")).when(point | end, at)).alias("finished_at"),
        F.min(F.when(F.col("_closed"), code("_after")).when(point, 0).when(end, code("phase"))).alias("_end"),
    )
    state = F.when(F.col("_end").isNull(), "RUNNING").when(F.col("_end") == 1, "TIMED_OUT").otherwise("COMPLETED")
    return spans.select("task_id", "kind", "seq", "name", "started_at", "finished_at", state.alias("state"))


def trace_tree(spans: DataFrame, as_of: Column) -> DataFrame:
    """Each span under its root: depth, offset from the root's start, time in all and time queued, in milliseconds.

    A span lasts from being queued to its end, or until ``as_of``. The spans are read once.
    """
    slim = cut_lineage(spans.select("id", "parent_id", "queued_at", "started_at", "finished_at"))
    roots = slim.where("parent_id is null")
    below = closure(slim, roots.select(F.col("id").alias("root_id"), "id"), cut=True)
    zero = roots.select(F.col("id").alias("root_id"), F.col("queued_at").alias("_zero"))
    rows = below.join(zero, "root_id").unionByName(roots.withColumns({"root_id": F.col("id"), "_zero": F.col("queued_at"), "depth": F.lit(0)}))
    return rows.select(
        "root_id", "id", "depth", millis_between("_zero", "queued_at").alias("start_ms"),
        millis_between("queued_at", F.coalesce("finished_at", as_of)).alias("duration_ms"), millis_between("queued_at", F.coalesce("started_at", as_of)).alias("queued_ms"),
    )


def with_ancestors(spans: DataFrame, match: Column) -> DataFrame:
    """Ids that match, and all that are above them; ``matched`` tells the former. The spans are read once."""
    slim = cut_lineage(spans.select("id", "parent_id", F.coalesce(match, F.lit(False)).alias("_match")))
    hits = slim.where("_match").select("id")
    up = slim.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("parent_id"))
    above = closure(up, hits.select(F.col("id").alias("root_id"), "id"), cut=True).select("id").distinct()
    return hits.withColumn("_m", F.lit(1)).unionByName(above.withColumn("_m", F.lit(0))).groupBy("id").agg((F.max("_m") == 1).alias("matched"))


def is_error(kind: Column, state: Column) -> Column:
    """Failed states; a timeout of something that only waits is none."""
    return state.isin("FAILED", "CRASHED") | ((state == "TIMED_OUT") & ~kind.isin("WAIT", "SLEEP", "CONDITION"))


def _contains(a: object, b: object) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_contains(x, y) for x in a) for y in b)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def _holds(whole: object, part: object) -> bool:
    if isinstance(whole, list) and not isinstance(part, (list, dict)):
        return any(_contains(x, part) for x in whole)
    return _contains(whole, part)


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(BooleanType())
def json_contains(whole: pd.Series, part: pd.Series) -> pd.Series:
    """Whether a JSON value holds another: objects by key, arrays as sets; false for what is no JSON.

    An array at the top also holds a bare scalar that is one of its elements.
    """
    return pd.Series([p is not None and _holds(w, p) for w, p in zip(map(_parsed, whole), map(_parsed, part))], dtype=bool)


def _leaves(value: object, path: str, out: dict[str, str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _leaves(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            _leaves(v, f"{path}[]", out)
    else:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        out[f"{path}={json.dumps(float(value) if number else value)}"] = ""


@F.pandas_udf(ArrayType(StringType()))
def json_leaves(text: pd.Series) -> pd.Series:
    """The scalar leaves of a JSON value, as path=value; what holds a value has all of its leaves."""
    found = []
    for v in map(_parsed, text):
        out: dict[str, str] = {}
        if v is not None:
            _leaves(v, "$", out)
            for x in v if isinstance(v, list) else ():  # it holds its scalars bare, too
                if not isinstance(x, (list, dict)):
                    _leaves(x, "$", out)
        found.append(list(out))
    return pd.Series(found)


def _keyed_waits(waits: DataFrame) -> DataFrame:
    """Waits with the leaves of their predicate; one without any has the empty leaf, which every event has."""
    found = F.array_sort(json_leaves("predicate"))
    return waits.withColumn("_leaves", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))))


def _keyed_events(events: DataFrame) -> DataFrame:
    leaf = F.explode(F.concat(json_leaves("payload"), F.array(F.lit("")))).alias("_leaf")
    return events.select("queue", "name", leaf, F.col("created_at").alias("_t"), F.struct(F.col("created_at").alias("t"), F.col("id").alias("e")).alias("_event"), "payload")


def _nearest(waits: DataFrame, events: DataFrame, later: bool) -> DataFrame:
    """(id, event): the first event at or after each wait's time, or the last one before it, of equal queue, name and leaf.

    Rows meet in slices of a day, so that a key with most of the rows spreads over its days. A
    wait that finds none in its own day takes the end of the nearest day that has some,
    from a table of one row for each key and day.
    """
    keys, day = ["queue", "name", "_leaf"], F.date_trunc("day", "_t").alias("_day")
    of_events = events.select(*keys, "_t", day, F.lit(1).alias("_o"), F.lit(None).cast("long").alias("id"), F.col("_event").cast(_EVENT).alias("_event"))
    none = F.lit(None).cast(_EVENT)
    asked_at = F.date_trunc("day", "created_at").alias("_day")
    # an event at the very time of a wait is a later one: it comes after the wait in order of time
    of_waits = waits.select(*keys, F.col("created_at").alias("_t"), asked_at, F.lit(0).alias("_o"), F.col("id").cast("long").alias("id"), none.alias("_event"))
    tie = F.coalesce(F.col("_event.e"), F.lit(0))
    order = [F.desc("_t"), F.desc("_o"), tie.desc()] if later else [F.asc("_t"), F.asc("_o"), tie.asc()]
    over = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = of_events.unionByName(of_waits).withColumn("_event", F.last("_event", ignorenulls=True).over(over)).where("id is not null")
    pick = F.min if later else F.max
    ends = of_events.groupBy(*keys, "_day").agg(pick("_event").alias("_end"))
    asked = near.where("_event is null").select(*keys, "_day").distinct().withColumn("_end", none)
    days = ends.unionByName(asked).groupBy(*keys, "_day").agg(F.first("_end", ignorenulls=True).alias("_end"))
    by_day = Window.partitionBy(*keys).orderBy(F.desc("_day") if later else F.asc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    other = days.withColumn("_other", F.last("_end", ignorenulls=True).over(by_day)).select(*keys, "_day", "_other")
    far = near.where("_event is null").join(other, [*keys, "_day"]).select("id", F.col("_other").alias("event"))
    return near.where("_event is not null").select("id", F.col("_event").alias("event")).unionByName(far).where("event is not null")


def _nearest_match(waits: DataFrame, events: DataFrame, later: bool) -> DataFrame:
    """(id, event): the nearest event that holds the wait's predicate, before the wait or at and after it.

    A predicate of one leaf, or none, is held by what has that leaf, so ``_nearest`` finds
    it. One of several is met on the leaf that fewest events have, then checked whole.
    """
    keyed = _keyed_waits(waits.select("id", "queue", "name", "predicate", "created_at"))
    leaves = _keyed_events(events)
    one = keyed.where(F.size("_leaves") == 1).withColumn("_leaf", F.col("_leaves")[0])
    near = _nearest(one, leaves.drop("payload"), later)
    several = keyed.where(F.size("_leaves") > 1).withColumn("_leaf", F.explode("_leaves"))
    keys = ["queue", "name", "_leaf"]
    common = leaves.groupBy(*keys).agg(F.count("*").alias("_n"))
    rarest = several.join(common, keys, "left").groupBy("id", "queue", "name", "predicate", "created_at")
    rarest = rarest.agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_leaf"))["_leaf"].alias("_leaf"))
    met = rarest.join(leaves, keys)
    met = met.where(F.col("_t") >= F.col("created_at") if later else F.col("_t") < F.col("created_at")).where(json_contains("payload", "predicate"))
    pick = F.min if later else F.max
    return near.unionByName(met.groupBy(F.col("id").cast("long").alias("id")).agg(pick("_event").cast(_EVENT).alias("event")))


def match_events(events: DataFrame, waits: DataFrame) -> DataFrame:
    """(wait_id, event_id, woken_at): the first event that wakes each waiting row, each being woken once.

    An event wakes a wait of its queue and name that was there before it and whose
    predicate its payload holds; a null or empty predicate is held by all. Waits and
    events meet in order of time, by one leaf of the predicate (see ``_nearest_match``).
    """
    found = _nearest_match(waits, events, later=True)
    return found.select(F.col("id").alias("wait_id"), F.col("event.e").alias("event_id"), F.col("event.t").alias("woken_at"))


def await_outcome(waits: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """How each wait stands: EVENT at once by the latest earlier event of its name, else by a later one before its timeout, TIMED_OUT, or WAITING."""
    held = _nearest_match(waits, events, later=False).select("id", F.col("event.e").alias("_before"))
    later = match_events(events, waits).select(F.col("wait_id").alias("id"), "event_id", "woken_at")
    rows = waits.join(held, "id", "left").join(later, "id", "left")
    limit = F.col("timeout_at")
    in_time = F.col("woken_at").isNotNull() & (limit.isNull() | (F.col("woken_at") <= limit))
    state = F.when(F.col("_before").isNotNull() | in_time, "EVENT").when(limit <= as_of, "TIMED_OUT").otherwise("WAITING")
    return rows.select("id", state.alias("state"), F.coalesce("_before", F.when(in_time, F.col("event_id"))).alias("event_id"))
