"""Hand-written fixtures that tell two readings of an operator apart."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowlens.functions.tables import closure
from flowlens.operators import dispatch as D
from flowlens.operators import metrics as M
from flowlens.operators import traces as X

NOW = datetime(2024, 1, 31)


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def ago(**k):
    return NOW - timedelta(**k)


def paired(events):
    """Spans of one task's events in order of seq, one at a time."""
    slots, lines, out = {}, {}, []
    done = lambda kind, name, start, end, phase: out.append((kind, start[0], name, start[1], end, {"TIMEOUT": "TIMED_OUT", "END": "COMPLETED"}.get(phase, "RUNNING")))
    for seq, kind, phase, name, at, timer in events:
        slot = name if kind == "WAIT" else timer if kind == "SLEEP" else None
        shown = name if kind == "WAIT" else kind.lower()
        if phase == "START":
            if slot is not None:
                slots[kind, slot] = (seq, at)
            else:
                lines.setdefault(kind, []).append((seq, at))
        elif slot is not None and (kind, slot) in slots:
            done(kind, shown, slots.pop((kind, slot)), at, phase)
        elif kind != "WAIT" and lines.get(kind):
            done(kind, shown, lines[kind].pop(0), at, phase)
    for (kind, slot), start in slots.items():
        done(kind, slot if kind == "WAIT" else kind.lower(), start, None, None)
    for kind, starts in lines.items():
        for start in starts:
            done(kind, kind.lower(), start, None, None)
    return out


def test_history_pairs_as_one_event_after_the_other(spark):
    rng = random.Random(3)
    rows, want = [], []
    for task in range(150):
        events = []
        for seq in range(rng.randint(1, 14)):
            kind = rng.choice(["SLEEP", "SLEEP", "WAIT", "CONDITION"])
            phase = rng.choice(["START", "START", "END"] if kind == "SLEEP" else ["START", "END", "TIMEOUT"])
            events.append((seq, kind, phase, rng.choice("ab") if kind == "WAIT" else None, NOW + timedelta(minutes=seq), rng.choice([None, None, 1, 2]) if kind == "SLEEP" else None))
        rows += [(task, *e) for e in events]
        want += [(task, *s) for s in paired(events)]
    history = spark.createDataFrame(rows, "task_id long, seq long, kind string, phase string, name string, at timestamp_ntz, timer_seq long")
    got = [(r.task_id, r.kind, r.seq, r.name, r.started_at, r.finished_at, r.state) for r in X.history_spans(history).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_end_without_an_open_start_is_dropped(spark):
    rows = [(1, 1, "SLEEP", "END", None, ago(days=2)), (1, 2, "SLEEP", "START", None, ago(days=1))]
    got = X.history_spans(spark.createDataFrame(rows, "task_id long, seq long, kind string, phase string, name string, at timestamp_ntz")).collect()
    assert [(r.seq, r.state) for r in got] == [(2, "RUNNING")]


def test_a_due_head_blocks_its_key_past_its_deadline(spark):
    rows = [
        (1, "x", "q", "PENDING", "RUNNING", 1, "k", ago(days=3), ago(days=1)), (2, "x", "q", "PENDING", "RUNNING", 1, "k", ago(days=2), None),
        (3, "y", "q", "PENDING", "RUNNING", 1, "k", ago(days=1), None), (4, "x", "q", "PENDING", "CANCELLED", 0, None, ago(days=1), None), (5, "x", "q", "SLEEPING", "RUNNING", 2, None, ago(days=1), None),
    ]
    cand = spark.createDataFrame(rows, "id long, namespace_id string, queue string, state string, task_state string, priority int, fairness_key string, available_at timestamp_ntz, deadline_at timestamp_ntz").withColumn("worker_id", F.lit(1))
    passes = spark.createDataFrame([], "namespace_id string, queue string, fairness_key string, pass double")
    assert [r.id for r in D.claim(cand, passes, now()).orderBy("pos").collect()] == [3, 5]


def test_continued_tasks_are_dated_by_their_completion(spark):
    rows = [(1, None, "CONTINUED_AS_NEW", ago(days=90), ago(days=1), None), (2, None, "CONTINUED_AS_NEW", ago(days=90), ago(days=60), None), (3, None, "FAILED", ago(days=90), None, None), (4, 5, "COMPLETED", ago(days=90), ago(days=80), None), (5, None, "RUNNING", ago(days=99), None, None), (6, 77, "CANCELLED", ago(days=90), None, ago(days=40))]
    tasks = spark.createDataFrame(rows, "id long, parent_id long, state string, created_at timestamp_ntz, completed_at timestamp_ntz, cancelled_at timestamp_ntz")
    assert sorted(r.id for r in D.prunable_tasks(tasks, now(), days=30).collect()) == [2, 3, 6]


def test_an_idle_workers_old_lease_does_not_make_it_healthy(spark):
    runs = [("x", 1, "COMPLETED", ago(minutes=5), NOW + timedelta(hours=1)), ("x", 2, "RUNNING", None, NOW + timedelta(hours=1)), ("x", 3, "CANCELLED", ago(minutes=1), None), ("y", 3, "FAILED", ago(minutes=1), None)]
    found = spark.createDataFrame(runs, "namespace_id string, worker_id long, state string, finished_at timestamp_ntz, lease_expires_at timestamp_ntz")
    workers = spark.createDataFrame([("x", i, 4, ago(hours=1)) for i in (1, 2, 3)], "namespace_id string, worker_id long, concurrency int, updated_at timestamp_ntz")
    got = {r.worker_id: (r.running, r.completed, r.failed, r.cancelled, r.healthy) for r in M.worker_activity(workers, found, now()).collect()}
    assert got == {1: (0, 0, 0, 0, False), 2: (1, 0, 0, 0, True), 3: (0, 0, 0, 1, False)}  # five minutes ago is no more recent


def test_an_array_holds_a_bare_scalar_at_the_top_only(spark):
    pairs = [('["a", 1]', '"a"', True), ('["a", 1]', "1.0", True), ('["a"]', '"b"', False), ('{"x": ["a"]}', '{"x": "a"}', False), ('[["a"]]', '"a"', False), ('"a"', '"a"', True), ('"a"', '["a"]', False)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(X.json_contains("a", "b").alias("y")).collect()
    assert [r.y for r in got] == [y for *_, y in pairs]
    for a, b, y in pairs:
        la, lb = ({k for r in spark.createDataFrame([(t,)], "t string").select(X.json_leaves("t").alias("l")).collect() for k in r.l} for t in (a, b))
        assert not y or lb <= la


def test_waits_and_events_over_days_against_all_pairs(spark):
    rng = random.Random(8)
    payloads = [{"k": 1}, {"k": 2}, {"k": 1, "m": {"n": [1, 2]}}, {"m": {"n": [2]}}]
    events = [(i, "q", "e", json.dumps(rng.choice(payloads)), NOW + timedelta(hours=7 * rng.randint(0, 40))) for i in range(60)]
    predicates = ["{}", '{"k": 1}', '{"k": 1, "m": {"n": [2]}}', '{"m": {"n": [1]}}', '{"k": 9}']
    waits = [(100 + i, "q", "e", predicates[i % 5], NOW + timedelta(hours=7 * rng.randint(0, 40)), None) for i in range(50)]
    e = spark.createDataFrame(events, "id long, queue string, name string, payload string, created_at timestamp_ntz")
    w = spark.createDataFrame(waits, "id long, queue string, name string, predicate string, created_at timestamp_ntz, timeout_at timestamp_ntz")
    fits = lambda x, y: X._contains(json.loads(x[3]), json.loads(y[3]))
    first = {y[0]: min(((x[4], x[0]) for x in events if x[4] >= y[4] and fits(x, y)), default=None) for y in waits}
    last = {y[0]: max(((x[4], x[0]) for x in events if x[4] < y[4] and fits(x, y)), default=None) for y in waits}
    assert {r.wait_id: (r.woken_at, r.event_id) for r in X.match_events(e, w).collect()} == {k: v for k, v in first.items() if v}
    got = {r.id: r.event_id for r in X.await_outcome(w, e, now()).collect()}
    assert got == {k: (last[k] or first[k] or (None, None))[1] for k in got} and len(got) == 50


def test_closure_follows_and_stops(spark):
    edges = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 2, None)], "id long, parent_id long, f boolean")
    got = {(r.root_id, r.id): r.depth for r in closure(edges, spark.createDataFrame([(1, 1), (2, 2)], "root_id long, id long"), F.col("f")).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 5): 2, (2, 3): 1, (2, 5): 1}
