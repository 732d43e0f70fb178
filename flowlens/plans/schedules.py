"""Queries of operators/schedules.py over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import schedules as C
from flowlens.sources import model as S

T, E = S.TASKS_SQL, S.EVENTS_SQL


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


LOW = lambda: ts("2024-01-01 00:00:00")
HIGH = lambda: ts("2024-02-01 00:00:00")
NOW = lambda: ts("2024-01-20 12:30:00")
WORK = C.cron("*/20 9-17 * * 1-5")
ODD = C.cron("30 6 1,15 * 0")
MINUTES = "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2026-06-01', INTERVAL 1 MINUTE)) AS m"
WORK_SQL = "minute(m) % 20 = 0 AND hour(m) BETWEEN 9 AND 17 AND dayofweek(m) BETWEEN 1 AND 5"
ODD_SQL = "minute(m) = 30 AND hour(m) = 6 AND (day(m) IN (1, 15) OR dayofweek(m) = 0)"


def times(spark, d):
    return S.table(spark, d, "events").select("event_id", F.col("ts").alias("at"))


def interval_schedules(spark, d):
    k = F.col("s_suppkey")
    accuracy = F.when(k % 3 == 0, "latest").when(k % 3 == 1, "all").otherwise("last:4")
    return S.table(spark, d, "supplier").select(k.alias("id"), F.timestamp_add("MINUTE", (k % 600).cast("int"), LOW()).alias("first_at"), (3600 * (1 + k % 30)).alias("step_s"), accuracy.alias("accuracy"), F.when(k % 4 != 0, F.timestamp_add("DAY", (k % 18).cast("int"), LOW())).alias("last_slot_at"))


SLOTS_SQL = """sch AS (SELECT s_suppkey AS id, TIMESTAMP '2024-01-01' + to_minutes(s_suppkey % 600) AS first_at, 3600 * (1 + s_suppkey % 30) AS step_s, CASE s_suppkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN 'all' ELSE 'last:4' END AS accuracy,
    CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 18 AS INTEGER)) END AS last_slot_at FROM supplier),
slots AS (SELECT sch.*, k, first_at + to_seconds(k * step_s) AS slot FROM sch, unnest(generate_series(0, 800)) AS t(k) WHERE first_at + to_seconds(k * step_s) < TIMESTAMP '2024-02-01')"""


def slots(spark, d):
    return C.interval_slots(interval_schedules(spark, d), HIGH())


def _backfills(spark, d):
    k = F.col("id")
    return interval_schedules(spark, d).select("id", F.timestamp_add("DAY", (k % 5).cast("int"), LOW()).alias("range_start"), F.timestamp_add("DAY", (k % 5 + 12).cast("int"), LOW()).alias("range_end"), F.when(k % 2 == 0, F.timestamp_add("DAY", F.lit(6), LOW())).alias("cursor"), (2 + k % 5).alias("concurrency"), (k % 3).alias("active"))


def _done(spark, d):
    epoch = F.timestamp_diff("SECOND", ts("1970-01-01 00:00:00"), F.col("slot"))
    return slots(spark, d).where("k % 4 = 1").select(F.concat_ws(":", F.lit("$backfill"), "id", epoch).alias("key"))


def _runs(spark, d):
    k = F.col("id") + F.col("k")
    state = F.when(k % 5 == 0, "FAILED").when(k % 7 == 0, "RUNNING").otherwise("COMPLETED")
    one = slots(spark, d).where((k % 11 != 0) & (F.col("slot") <= NOW())).select("id", "slot", state.alias("state"), F.timestamp_add("MINUTE", F.lit(1), F.col("slot")).alias("created_at"), F.col("k").alias("run_id"))
    again = slots(spark, d).where((k % 10 == 0) & (F.col("slot") <= NOW())).select("id", "slot", F.lit("COMPLETED").alias("state"), F.timestamp_add("HOUR", F.lit(1), F.col("slot")).alias("created_at"), F.col("k").alias("run_id"))
    return one.unionByName(again)


def _next(kind, **how):
    return lambda s, d: times(s, d).select("event_id", C.calendar_next(kind, F.col("at"), **how).alias("next"))


def _epochs(spark, d):
    return times(spark, d).select("event_id", F.timestamp_diff("SECOND", ts("1970-01-01 00:00:00"), F.col("at")).alias("e"))


_EPOCH = "SELECT event_id, epoch_us(ts) // 1000000 AS e FROM events"

NY = "America/New_York"


def _orders(spark, d):
    """UTC times of all hours over years with changes of summer time."""
    return S.table(spark, d, "orders").select("o_orderkey", F.timestamp_add("MINUTE", (F.col("o_orderkey") * 7 % 1440).cast("int"), F.col("o_orderdate")).alias("at"))


ZONED = f"""o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey * 7 % 1440) AS ts FROM orders), x AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE '{NY}' AS l FROM o)"""


def _utc(local: str) -> str:
    return f"(({local}) AT TIME ZONE '{NY}') AT TIME ZONE 'UTC'"


def _zoned_intervals(spark, d):
    rows = _orders(spark, d).select("o_orderkey", F.timestamp_diff("SECOND", ts("1970-01-01 00:00:00"), F.col("at")).alias("e"))
    return rows.select("o_orderkey", *[C.interval_next(F.col("e"), n, o, NY).alias(f"n{n}_{o}") for n, o in ((3600, 2700), (5400, 300), (1209600, 0))])


def _zoned_next(spark, d):
    at = F.col("at")
    return _orders(spark, d).select("o_orderkey", C.calendar_next("daily", at, hour=9, zone=NY).alias("d"), C.calendar_next("weekly", at, hour=8, weekday=3, zone=NY).alias("w"), C.calendar_next("monthly", at, hour=4, day=31, zone=NY).alias("m"))


def _scheduled(spark, d):
    at = F.col("at")
    return _orders(spark, d).select(
        "o_orderkey", C.scheduled_time("daily", at, hour=9, zone=NY).alias("d"), C.scheduled_time("weekly", at, hour=8, weekday=3, zone=NY).alias("w"), C.scheduled_time("monthly", at, hour=1, day=15, zone=NY).alias("m"),
        C.scheduled_time("yearly", at, hour=12, month=6, day=2, zone=NY).alias("y"), C.scheduled_time("interval", at, seconds=5400).alias("i"), C.scheduled_time("once", at, date=ts("1998-01-01 00:00:00")).alias("o"),
    )


QUERIES = {
    "interval_next_zoned": (
        _zoned_intervals,
        f"""WITH {ZONED}, e AS (SELECT o_orderkey, l, epoch_us(ts) // 1000000 AS e, epoch_us(l) // 1000000 - epoch_us(ts) // 1000000 AS a FROM x)
        SELECT o_orderkey, ((e + a) // 3600 + 1) * 3600 - a + 2700 AS n3600_2700, CAST(floor((e + a - 300) / 5400) + 1 AS BIGINT) * 5400 + 300 - a AS n5400_300, epoch_us({_utc("date_trunc('day', l) + INTERVAL 14 DAY")}) // 1000000 AS n1209600_0 FROM e""",
    ),
    "calendar_next_zoned": (
        _zoned_next,
        f"""WITH {ZONED}, c AS (SELECT o_orderkey, ts, {_utc("date_trunc('day', l)::TIMESTAMP + INTERVAL 9 HOUR")} AS d0, {_utc("date_trunc('day', l)::TIMESTAMP + INTERVAL 33 HOUR")} AS d1,
            {_utc("date_trunc('day', l)::TIMESTAMP + to_days(CAST((3 - dayofweek(l) + 7) % 7 AS INTEGER)) + INTERVAL 8 HOUR")} AS w0, {_utc("date_trunc('day', l)::TIMESTAMP + to_days(CAST((3 - dayofweek(l) + 7) % 7 AS INTEGER)) + INTERVAL 7 DAY + INTERVAL 8 HOUR")} AS w1,
            {_utc("last_day(l)::TIMESTAMP + INTERVAL 4 HOUR")} AS m0, {_utc("last_day(date_trunc('month', l) + INTERVAL 1 MONTH)::TIMESTAMP + INTERVAL 4 HOUR")} AS m1 FROM x)
        SELECT o_orderkey, CASE WHEN d0 > ts THEN d0 ELSE d1 END AS d, CASE WHEN w0 > ts THEN w0 ELSE w1 END AS w, CASE WHEN m0 > ts THEN m0 ELSE m1 END AS m FROM c""",
    ),
    "scheduled_time": (
        _scheduled,
        f"""WITH {ZONED}, c AS (SELECT o_orderkey, ts, {_utc("date_trunc('day', l)::TIMESTAMP + INTERVAL 9 HOUR")} AS d0, {_utc("date_trunc('day', l)::TIMESTAMP - INTERVAL 15 HOUR")} AS d1,
            {_utc("date_trunc('day', l)::TIMESTAMP - to_days(CAST((dayofweek(l) - 3 + 7) % 7 AS INTEGER)) + INTERVAL 8 HOUR")} AS w0, {_utc("date_trunc('month', l)::TIMESTAMP + INTERVAL 14 DAY + INTERVAL 1 HOUR")} AS m0,
            {_utc("date_trunc('month', l)::TIMESTAMP - INTERVAL 1 MONTH + INTERVAL 14 DAY + INTERVAL 1 HOUR")} AS m1, {_utc("make_timestamp(year(l), 6, 2, 12, 0, 0)")} AS y0, {_utc("make_timestamp(year(l) - 1, 6, 2, 12, 0, 0)")} AS y1 FROM x)
        SELECT o_orderkey, CASE WHEN d0 <= ts THEN d0 ELSE d1 END AS d, CASE WHEN w0 <= ts THEN w0 END AS w, CASE WHEN m0 <= ts THEN m0 ELSE m1 END AS m, CASE WHEN y0 <= ts THEN y0 ELSE y1 END AS y,
            TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch_us(ts) / 1000000 / 5400) AS BIGINT) * 5400) AS i, CASE WHEN TIMESTAMP '1998-01-01' <= ts THEN TIMESTAMP '1998-01-01' END AS o FROM c""",
    ),
    "cron_prev": (
        lambda s, d: C.cron_prev(times(s, d), "at", WORK).select("event_id", "prev"),
        f"WITH mm AS (SELECT unnest(generate_series(TIMESTAMP '2022-12-01', TIMESTAMP '2024-06-01', INTERVAL 1 MINUTE)) AS m), f AS (SELECT m FROM mm WHERE {WORK_SQL}) SELECT event_id, f.m AS prev FROM events e ASOF JOIN f ON e.ts > f.m",
    ),
    "cron_scheduled": (
        lambda s, d: C.cron_scheduled(times(s, d), "at", ODD).select("event_id", "scheduled"),
        f"WITH mm AS (SELECT unnest(generate_series(TIMESTAMP '2022-12-01', TIMESTAMP '2024-06-01', INTERVAL 1 MINUTE)) AS m), f AS (SELECT m FROM mm WHERE {ODD_SQL}), e AS (SELECT event_id, ts + INTERVAL 1 SECOND AS ts FROM events) SELECT event_id, f.m AS scheduled FROM e ASOF JOIN f ON e.ts > f.m",
    ),
    "cron_next_zoned": (
        lambda s, d: C.in_zone(times(s, d), "at", NY, lambda t, at: C.cron_next(t, at, WORK), "next").select("event_id", "next"),
        f"WITH mm AS ({MINUTES}), f AS (SELECT {_utc('m')} AS u FROM mm WHERE {WORK_SQL}) SELECT event_id, f.u AS next FROM events e ASOF JOIN f ON e.ts < f.u",
    ),
    "cron_last": (
        lambda s, d: C.cron_last(s, WORK, NOW(), 40),
        f"WITH mm AS (SELECT unnest(generate_series(TIMESTAMP '2023-01-20', TIMESTAMP '2024-01-20 12:29:00', INTERVAL 1 MINUTE)) AS m) SELECT m AS slot FROM mm WHERE {WORK_SQL} ORDER BY m DESC LIMIT 40",
    ),
    "cron_following": (
        lambda s, d: C.cron_following(s, WORK, NOW(), 40),
        f"WITH mm AS ({MINUTES}) SELECT m AS slot FROM mm WHERE m > TIMESTAMP '2024-01-20 12:30:00' AND {WORK_SQL} ORDER BY m LIMIT 40",
    ),
    "partition_time_as_is": (
        lambda s, d: times(s, d).select("event_id", *[C.partition_time(k, F.col("at")).alias(k) for k in ("cron", "once", "yearly", "timetable")]),
        "SELECT event_id, ts AS cron, ts AS once, ts AS yearly, ts AS timetable FROM events",
    ),
    "cron_slots": (lambda s, d: C.cron_slots(s, WORK, LOW(), HIGH()), f"WITH mm AS ({MINUTES}) SELECT m AS slot FROM mm WHERE m < TIMESTAMP '2024-02-01' AND {WORK_SQL}"),
    "cron_matches": (
        lambda s, d: times(s, d).select("event_id", C.cron_matches(C.cron("*/3 * */2 * 2"), F.col("at")).alias("fits")),
        "SELECT event_id, minute(ts) % 3 = 0 AND (day(ts) % 2 = 1 OR dayofweek(ts) = 2) AS fits FROM events",
    ),
    "cron_next": (
        lambda s, d: C.cron_next(times(s, d), "at", WORK).select("event_id", "next"),
        f"WITH mm AS ({MINUTES}), f AS (SELECT m FROM mm WHERE {WORK_SQL}) SELECT event_id, f.m AS next FROM events e ASOF JOIN f ON e.ts < f.m",
    ),
    "cron_next_day_or_weekday": (
        lambda s, d: C.cron_next(times(s, d), "at", ODD).select("event_id", "next"),
        f"WITH mm AS ({MINUTES}), f AS (SELECT m FROM mm WHERE {ODD_SQL}) SELECT event_id, f.m AS next FROM events e ASOF JOIN f ON e.ts < f.m",
    ),
    "interval_next": (
        lambda s, d: _epochs(s, d).select("event_id", *[C.interval_next(F.col("e"), n, o).alias(f"n{n}_{o}") for n, o in ((300, 0), (5400, 2700), (3600, 2700), (604800, 0))]),
        f"SELECT event_id, (e // 300 + 1) * 300 AS n300_0, ((e - 2700) // 5400 + 1) * 5400 + 2700 AS n5400_2700, (e // 3600 + 1) * 3600 + 2700 AS n3600_2700, e // 86400 * 86400 + 604800 AS n604800_0 FROM ({_EPOCH})",
    ),
    "daily_next": (_next("daily", hour=9), "SELECT event_id, date_trunc('day', ts)::TIMESTAMP + INTERVAL 9 HOUR + CASE WHEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 9 HOUR > ts THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS next FROM events"),
    "weekly_next": (
        _next("weekly", hour=8, weekday=3),
        "WITH x AS (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 8 HOUR + to_days(CAST((3 - dayofweek(ts) + 7) % 7 AS INTEGER)) AS t FROM events) SELECT event_id, CASE WHEN t > ts THEN t ELSE t + INTERVAL 7 DAY END AS next FROM x",
    ),
    "monthly_next": (
        _next("monthly", hour=1, day=31),
        """WITH x AS (SELECT event_id, ts, last_day(ts)::TIMESTAMP + INTERVAL 1 HOUR AS t, last_day(date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP + INTERVAL 1 HOUR AS u FROM events) SELECT event_id, CASE WHEN t > ts THEN t ELSE u END AS next FROM x""",
    ),
    "yearly_next": (
        _next("yearly", day=15, month=1),
        "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2025-01-15' END AS next FROM events",
    ),
    "once_next": (lambda s, d: times(s, d).select("event_id", C.once_next(F.col("at"), NOW()).alias("next")), "SELECT event_id, CASE WHEN TIMESTAMP '2024-01-20 12:30:00' > ts THEN TIMESTAMP '2024-01-20 12:30:00' END AS next FROM events"),
    "timetable": (
        lambda s, d: C.business_next(times(s, d), "at", s.sql("SELECT explode(array(date '2024-01-15', date '2024-01-16')) AS day")).select("event_id", "next"),
        """WITH c AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY))::TIMESTAMP AS day), b AS (SELECT day FROM c WHERE dayofweek(day) BETWEEN 1 AND 5 AND day NOT IN (TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-16'))
        SELECT event_id, min(day) AS next FROM events JOIN b ON day > date_trunc('day', ts) AND day <= date_trunc('day', ts) + INTERVAL 14 DAY GROUP BY 1""",
    ),
    "partition_time": (
        lambda s, d: times(s, d).select("event_id", C.partition_time("daily", F.col("at")).alias("d"), C.partition_time("weekly", F.col("at")).alias("w"), C.partition_time("monthly", F.col("at")).alias("m"), C.partition_time("interval", F.col("at"), 5400).alias("i")),
        "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('day', ts)::TIMESTAMP - to_days(CAST(dayofweek(ts) AS INTEGER)) AS w, date_trunc('month', ts)::TIMESTAMP AS m, TIMESTAMP '1970-01-01' + to_seconds(epoch_us(ts) // 1000000 // 5400 * 5400) AS i FROM events",
    ),
    "default_partition_offset": (
        lambda s, d: interval_schedules(s, d).select("id", C.default_offset(F.when(F.col("id") % 2 == 0, "interval").otherwise("weekly"), F.when(F.col("id") % 4 == 0, F.col("step_s")).otherwise(F.lit(90))).alias("o")),
        "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 1 THEN 'P7D' WHEN s_suppkey % 4 = 0 THEN 'PT' || (1 + s_suppkey % 30) || 'H' ELSE 'PT90S' END AS o FROM supplier",
    ),
    "slots": (lambda s, d: slots(s, d).select("id", "k", "slot"), f"WITH {SLOTS_SQL} SELECT id, k, slot FROM slots"),
    "count_slots": (lambda s, d: slots(s, d).groupBy("id").agg(F.count("*").alias("n")), f"WITH {SLOTS_SQL} SELECT id, count(*) AS n FROM slots GROUP BY 1"),
    "catch_up": (
        lambda s, d: C.catch_up(slots(s, d), NOW()),
        f"""WITH {SLOTS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY slot DESC) AS b FROM slots WHERE slot <= TIMESTAMP '2024-01-20 12:30:00' AND (last_slot_at IS NULL OR slot > last_slot_at))
        SELECT id, slot FROM m WHERE accuracy = 'all' OR b <= CASE accuracy WHEN 'latest' THEN 1 ELSE 4 END""",
    ),
    "backfill_plan": (
        lambda s, d: C.backfill_plan(slots(s, d).select("id", "slot"), _backfills(s, d), _done(s, d)),
        f"""WITH {SLOTS_SQL}, k AS (SELECT id, slot, k, '$backfill:' || id || ':' || (epoch_us(slot) // 1000000) AS key FROM slots WHERE slot >= TIMESTAMP '2024-01-01' + to_days(CAST(id % 5 AS INTEGER)) AND slot < TIMESTAMP '2024-01-01' + to_days(CAST(id % 5 + 12 AS INTEGER))
            AND (id % 2 = 1 OR slot > TIMESTAMP '2024-01-07') AND k % 4 <> 1) SELECT id, slot, key FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY slot) <= 2 + id % 5 - id % 3""",
    ),
    "upcoming": (
        lambda s, d: C.upcoming(slots(s, d), NOW()).select("id", "slot", "pos"),
        f"WITH {SLOTS_SQL} SELECT id, slot, row_number() OVER (PARTITION BY id ORDER BY slot) AS pos FROM slots WHERE slot >= TIMESTAMP '2024-01-20 12:30:00' QUALIFY pos <= 20",
    ),
    "partition_grid": (
        lambda s, d: C.partition_grid(slots(s, d), _runs(s, d), NOW()),
        f"""WITH {SLOTS_SQL}, r AS (SELECT id, slot, CASE WHEN (id + k) % 10 = 0 AND slot <= TIMESTAMP '2024-01-20 12:30:00' THEN 'COMPLETED' WHEN (id + k) % 11 = 0 OR slot > TIMESTAMP '2024-01-20 12:30:00' THEN NULL WHEN (id + k) % 5 = 0 THEN 'FAILED' WHEN (id + k) % 7 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS st FROM slots),
        g AS (SELECT id, slot, CAST(slot AS DATE) AS day, coalesce(st, CASE WHEN slot > TIMESTAMP '2024-01-20 12:30:00' THEN 'UPCOMING' ELSE 'MISSING' END) AS state FROM r)
        SELECT *, (count(*) FILTER (state = 'COMPLETED') OVER (PARTITION BY id, day)) / nullif(count(*) FILTER (state <> 'UPCOMING') OVER (PARTITION BY id, day), 0) AS complete FROM g""",
    ),
}
