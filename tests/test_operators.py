"""Golden values and edge cases of the operators that the test tables don't reach."""

import json
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens import plans
from flowlens.functions import columns as C
from flowlens.functions.tables import closure
from flowlens.operators import dispatch as D
from flowlens.operators import schedules as S
from flowlens.operators import sketches as K
from flowlens.operators import traces as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("seconds,offset,after,then", [(300, 0, 420, 600), (900, 0, 420, 900), (1800, 0, 420, 1800), (2700, 0, 420, 2700), (5400, 2700, 600, 2700), (5400, 2700, 2700, 8100), (5400, 0, 600, 5400), (3600, 2700, 600, 6300), (3600, 2700, 6300, 9900)])
def test_interval_next(spark, seconds, offset, after, then):
    assert one(spark, S.interval_next(F.lit(after), seconds, offset)) == then


@pytest.mark.parametrize("ms,label", [(0, "0ms"), (999, "999ms"), (1000, "1s"), (59_999, "59s"), (60_000, "1m"), (61_500, "1m 1s"), (3_600_000, "1h"), (3_660_000, "1h 1m"), (86_400_000, "1d"), (90_000_000, "1d 1h")])
def test_sleep_label(spark, ms, label):
    assert one(spark, C.sleep_label(F.lit(ms))) == label


def test_cron_fields():
    assert S.cron("*/20 9-17 1,15 * 7").weekdays == (0,)
    assert S.cron("5/15 * * * *").minutes == (5,)
    assert S.cron("0-30/10 0 * * * 2024").years == (2024,)
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            S.cron(bad)


def test_slot_counts(spark):
    low = "2024-06-01 00:00:00"
    assert S.cron_slots(spark, S.cron("0 * * * *"), ts(low), ts("2024-06-02 00:00:00")).count() == 24
    assert S.cron_slots(spark, S.cron("0 9 * * *"), ts(low), ts("2024-06-08 00:00:00")).count() == 7
    assert S.cron_slots(spark, S.cron("0 9 * * *"), ts(low), ts(low)).count() == 0
    assert S.cron_slots(spark, S.cron("* * * * *"), ts(low), ts("2024-06-08 00:00:00"), limit=100).count() == 100


def test_calendar_ends_of_months(spark):
    assert one(spark, S.calendar_next("monthly", ts("2024-01-31 12:00:00"), hour=9, day=31)) == datetime(2024, 2, 29, 9)
    assert one(spark, S.calendar_next("yearly", ts("2024-03-01 00:00:00"), month=2, day=29)) == datetime(2025, 2, 28)


def test_durations(spark):
    d = C.iso_duration(F.lit("P1M2DT3H"))
    assert one(spark, C.duration_seconds(d)) == (32 * 86400 + 3 * 3600)
    assert one(spark, C.add_duration(ts("2024-01-31 00:00:00"), C.iso_duration(F.lit("P1M")))) == datetime(2024, 2, 29)
    for bad in ("", "P", "PT", "1D", "P1W", "PT1.5S"):
        assert one(spark, C.iso_duration(F.lit(bad))) is None


def test_uuid7_time(spark):
    assert one(spark, C.uuid7_time(F.lit("018f0000-0000-7abc-8def-0123456789ab")).cast("long")) == 0x018F00000000 // 1000
    assert one(spark, C.uuid7_time(F.lit("018f0000-0000-4abc-8def-0123456789ab"))) is None


def test_uuid7_times_beyond_48_bits(spark, tmp_path):
    days = [0, 1, 3_257_812, 3_257_813, 5_999_999, None]
    spark.createDataFrame([(n,) for n in days], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.us for r in plans.queries()["uuid7_time"](spark, str(tmp_path)).selectExpr("event_id", "unix_micros(cast(at as timestamp)) AS us").collect()}
    assert got == {n: n * 86_400_000_000 if n and n % 3 else None for n in days}
    assert one(spark, C.uuid7_time(F.lit("00000000-0001-7abc-8def-0123456789ab"), 1).cast("double")) == ((1 << 48) + 1) / 1000


def test_retry_delay(spark):
    assert [one(spark, C.retry_delay(F.lit(n))) for n in (0, 1, 2, 5, 20)] == [2, 2, 4, 32, 300]


def test_trend_and_flags(spark):
    assert one(spark, C.trend_label(F.lit("it is stable, not declining"))) == "DECLINING"
    assert one(spark, C.trend_label(F.lit(None))) == "UNKNOWN"
    assert one(spark, C.limit_flags(F.lit(27.0), F.lit(None).cast("double"), F.lit(20.0))).asDict() == {"too_hot": True, "stale_air": False, "too_dry": True}


def test_sketch_is_within_its_error_and_merges(spark):
    df = spark.range(1, 1001).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    qs = (0.0, 0.5, 0.95, 0.99, 1.0)
    whole = K.quantiles(K.sketch(df, ["k"], "v"), ["k"], qs).first()
    halves = K.merge(K.sketch(df.where("v <= 500"), ["k"], "v"), K.sketch(df.where("v > 500"), ["k"], "v"), keys=["k"])
    assert K.quantiles(halves, ["k"], qs).first() == whole
    assert whole["p0"] == 1 and whole["p100"] == 1000
    for q, v in ((0.5, 500), (0.95, 950), (0.99, 990)):
        assert abs(whole[f"p{q * 100:g}"] - v) <= 0.0201 * v
    assert K.sketch(spark.createDataFrame([("k", 0.0), ("k", -1.0), ("k", None)], "k string, v double"), ["k"], "v").count() == 0
    assert abs(K.quantiles(K.sketch(spark.createDataFrame([("k", 42.0)], "k string, v double"), ["k"], "v"), ["k"]).first()["p50"] - 42) < 1e-9


def test_fairness_never_underestimates_and_a_light_key_comes_first(spark):
    served = spark.createDataFrame([("q", f"t{i % 60}", 1.0) for i in range(600)], "queue string, fairness_key string, fairness_weight double")
    empty = spark.createDataFrame([], "queue string, cell int, value double")
    sketch = D.fairness_advance(empty, served)
    assert all(r["pass"] >= 10_000 for r in D.fairness_pass(sketch, served).collect())
    rows = [(i, "q", "PENDING", 3, "heavy", 0) for i in range(20)] + [(99, "q", "PENDING", 3, "light", 1)]
    cand = spark.createDataFrame(rows, "id long, queue string, state string, priority int, fairness_key string, m int").withColumns({"available_at": ts("2024-01-01 00:00:00"), "deadline_at": F.lit(None).cast("timestamp_ntz"), "worker_id": F.lit(1)})
    passes = spark.createDataFrame([("q", "heavy", 5000.0)], "queue string, fairness_key string, pass double")
    assert [r.id for r in D.claim(cand, passes, ts("2024-01-02 00:00:00")).orderBy("pos").collect()] == [99, 0]


def test_fairness_rebases_large_values(spark):
    big = spark.createDataFrame([("q", 1, 2e11), ("q", 2, 5.0)], "queue string, cell int, value double")
    served = spark.createDataFrame([], "queue string, fairness_key string, fairness_weight double")
    assert sorted(r.value for r in D.fairness_advance(big, served).collect()) == [0.0, 2e11 - 5]


def test_rate_limit_spaces_a_bucket_and_heals_an_idle_one(spark):
    req = spark.createDataFrame([("q", k, i, i, 10_000) for k in "ab" for i in range(3)], "queue string, slot_key string, run_id long, ord long, interval_ms long").withColumn("available_at", ts("2024-01-01 00:00:00"))
    cur = spark.createDataFrame([("q", "a")], "queue string, slot_key string").withColumn("next_slot_at", ts("2023-01-01 00:00:00"))
    got = {(r.slot_key, r.run_id): r.available_at for r in D.rate_limit_slots(req, cur, ts("2024-01-01 00:00:00")).collect()}
    assert [got["a", i].second for i in range(3)] == [0, 10, 20] and [got["b", i].second for i in range(3)] == [0, 10, 20]


def test_closure_of_nothing_and_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(6)], "id long, parent_id long")
    start = edges.where("id = 0").select(F.col("id").alias("root_id"), "id")
    assert sorted((r.id, r.depth) for r in closure(edges, start).collect()) == [(i, i) for i in range(1, 6)]
    assert closure(edges, start.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        closure(spark.createDataFrame([(0, 1), (1, 0)], "id long, parent_id long"), start, most=5)


def test_cascade_by_policy(spark):
    rows = [(1, None, "WORKFLOW", "CANCELLED", None), (2, 1, "WORKFLOW", "RUNNING", "REQUEST_CANCEL"), (3, 2, "ACTIVITY", "RUNNING", None), (4, 1, "ACTIVITY", "PENDING", "TERMINATE"), (5, 4, "WORKFLOW", "WAITING", "ABANDON"), (6, 4, "ACTIVITY", "COMPLETED", None), (7, 4, "ACTIVITY", "RUNNING", "REQUEST_CANCEL")]
    tasks = spark.createDataFrame(rows, "id long, parent_id long, kind string, state string, parent_close_policy string")
    got = {r.id: r.action for r in D.cancel_cascade(tasks, tasks.where("id = 1")).collect()}
    assert got == {2: "REQUEST_CANCEL", 4: "TERMINATE"}


json_values = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from("ab"), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("xyz"), x, max_size=3), max_leaves=6)


@given(json_values, json_values)
def test_containment_implies_leaves(a, b):
    assert X._contains(a, a)
    leaves = lambda v: (out := {}, X._leaves(v, "$", out))[0].keys()
    if X._contains(a, b):
        assert leaves(b) <= leaves(a)


def test_waits_take_the_first_event_that_fits(spark):
    events = spark.createDataFrame([(i, "q", "e", json.dumps(p), datetime(2024, 1, i)) for i, p in ((1, {"a": {"b": 1}}), (2, {"a": {"b": 2, "c": [1, 2]}}), (3, {"a": {"b": 2.0}}))], "id long, queue string, name string, payload string, created_at timestamp_ntz")
    waits = spark.createDataFrame([(10, "q", "e", '{"a": {"b": 2}}', datetime(2024, 1, 1)), (11, "q", "e", "{}", datetime(2024, 1, 2, 1)), (12, "q", "e", '{"a": {"c": [2]}}', datetime(2024, 1, 1)), (13, "q", "e", '{"a": {"b": "2"}}', datetime(2024, 1, 1)), (14, "q", "e", "no json", datetime(2024, 1, 1))], "id long, queue string, name string, predicate string, created_at timestamp_ntz")
    got = {r.wait_id: r.event_id for r in X.match_events(events, waits.where("id <> 14")).collect()}
    assert got == {10: 2, 11: 3, 12: 2}


def test_history_pairs(spark):
    at = lambda n: datetime(2024, 1, 1, n)
    rows = [(1, 1, "WAIT", "START", "n", at(1)), (1, 2, "WAIT", "START", "n", at(2)), (1, 3, "WAIT", "TIMEOUT", "n", at(3)), (1, 4, "SLEEP", "START", None, at(4)), (1, 5, "SLEEP", "START", None, at(5)), (1, 6, "SLEEP", "END", None, at(6)), (1, 7, "SIGNAL", "POINT", "s", at(7))]
    got = {(r.kind, r.seq): (r.state, r.finished_at) for r in X.history_spans(spark.createDataFrame(rows, "task_id long, seq long, kind string, phase string, name string, at timestamp_ntz")).collect()}
    assert got == {("WAIT", 2): ("TIMED_OUT", at(3)), ("SLEEP", 4): ("COMPLETED", at(6)), ("SLEEP", 5): ("RUNNING", None), ("SIGNAL", 7): ("COMPLETED", at(7))}
