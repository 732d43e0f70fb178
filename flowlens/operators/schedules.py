"""Calendars: when schedules fire, which slots a span of time has, and what became of them.

A schedule is a row; its times are rows too. Cron fields are read once, on the
driver, into sets of numbers, and slots are found by filtering days, hours and
minutes, so that a schedule costs what its slots do, not what its minutes do.
Functions with a ``zone`` take and give UTC times and reckon by that zone's clock, so
that days keep their length in local time over changes of summer time. A local time
that such a change skips is as much later; one that comes twice is the first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slots of one schedule that are ever listed, and missed ones that are caught up at once.
MOST_SLOTS, MOST_CATCH_UP = 100_000, 1000


@dataclass(frozen=True)
class Cron:
    """The numbers that each field allows; ``any_*`` tells a field that was a plain star."""

    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]  # 0 is Sunday
    years: tuple[int, ...] | None
    any_day: bool
    any_weekday: bool


def _field(text: str, low: int, high: int) -> tuple[int, ...]:
    """A list of numbers, ranges, and stars or ranges with a step. A step behind a lone number counts for nothing."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            lo, hi = low, high
        elif "-" in span:
            lo, hi = map(int, span.split("-"))
        else:
            lo = hi = int(span)
        every = int(step) if step else 1
        if lo > hi or lo < low or hi > high or every < 1:
            raise ValueError(f"{part!r} is not within {low}-{high}")
        out.update(range(lo, hi + 1, every))
    return tuple(sorted(out))


def cron(text: str) -> Cron:
    """minute hour day month weekday [year]; weekday 7 is Sunday too. Raises ValueError for anything else."""
    fields = text.split()
    if len(fields) not in (5, 6):
        raise ValueError(f"5 or 6 fields are needed: {text!r}")
    weekdays = tuple(sorted({d % 7 for d in _field(fields[4], 0, 7)})) if fields[4] != "*" else tuple(range(7))
    return Cron(_field(fields[0], 0, 59), _field(fields[1], 0, 23), _field(fields[2], 1, 31), _field(fields[3], 1, 12), weekdays, _field(fields[5], 1970, 3000) if len(fields) == 6 and fields[5] != "*" else None, fields[2] == "*", fields[4] == "*")


def day_matches(c: Cron, day: Column) -> Column:
    """Whether a date fits: if both day and weekday are given, either will do."""
    in_month, in_week = F.dayofmonth(day).isin(*c.days), (F.dayofweek(day) - 1).isin(*c.weekdays)
    either = (in_month | in_week) if not c.any_day and not c.any_weekday else (in_month & in_week)
    fits = F.month(day).isin(*c.months) & either
    return fits if c.years is None else fits & F.year(day).isin(*c.years)


def cron_matches(c: Cron, at: Column) -> Column:
    return F.minute(at).isin(*c.minutes) & F.hour(at).isin(*c.hours) & day_matches(c, at)


def cron_slots(spark: SparkSession, c: Cron, low: Column, high: Column, limit: int = MOST_SLOTS) -> DataFrame:
    """(slot): the times in [low, high) that fit, the first ``limit`` of them."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(low), F.to_date(high))).alias("d")).where(day_matches(c, F.col("d")))
    minutes = F.array(*[F.lit(h * 60 + m) for h in c.hours for m in c.minutes])
    slots = days.select("d", F.explode(minutes).alias("m")).select(F.timestamp_add("MINUTE", F.col("m"), F.col("d").cast("timestamp_ntz")).alias("slot"))
    return slots.where((F.col("slot") >= low) & (F.col("slot") < high)).orderBy("slot").limit(limit)


def cron_next(times: DataFrame, at: str, c: Cron, years: int = 1) -> DataFrame:
    """``times`` with ``next``, the first fitting time after ``at``, null if none comes within ``years``.

    Only the days that fit, a few hundred a year, are joined, and only the next one
    to each day of ``times``; the time within a day is a lookup in a fixed list.
    """
    minutes = [h * 60 + m for h in c.hours for m in c.minutes]
    minute = F.hour(at) * 60 + F.minute(at)
    bounds = times.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    days = bounds.where("lo is not null").select(F.explode(F.sequence(F.to_date("lo"), F.add_months(F.to_date("hi"), 12 * years))).alias("d")).withColumn("fits", day_matches(c, F.col("d")))
    later = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(1, Window.unboundedFollowing)  # one row a day
    calendar = days.select("d", "fits", F.first(F.when(F.col("fits"), F.col("d")), ignorenulls=True).over(later).alias("following"))
    rows = times.withColumns({"_d": F.to_date(at), "_m": minute}).join(F.broadcast(calendar), F.col("_d") == F.col("d"), "left")
    today = F.when(F.col("fits"), F.try_element_at(F.filter(F.array(*map(F.lit, minutes)), lambda m: m > F.col("_m")), F.lit(1)))
    at_day = lambda d, m: F.timestamp_add("MINUTE", m, d.cast("timestamp_ntz"))
    nxt = F.coalesce(at_day(F.col("_d"), today), at_day(F.col("following"), F.lit(minutes[0])))
    return rows.withColumn("next", nxt).select(*times.columns, "next")


def to_local(at: Column, zone: str) -> Column:
    return at.cast("timestamp_ntz") if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))


def to_utc(local: Column, zone: str) -> Column:
    return local.cast("timestamp_ntz") if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))


def _epoch(at: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def _from_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def interval_next(after: Column, seconds: int, offset: int = 0, zone: str = "UTC") -> Column:
    """Epoch seconds of an interval schedule's next time after ``after`` (epoch seconds).

    An hour goes to the zone's next full hour, whole days to the start of its day so
    many days on; in both, the offset is added behind that. Other lengths follow a
    grid from the epoch in local seconds, which the offset shifts.
    """
    after = after.cast("long")
    local = to_local(_from_epoch(after), zone)
    ahead = F.lit(0).cast("long") if zone == "UTC" else _epoch(local) - after
    if seconds == 3600:
        return (F.floor((after + ahead) / 3600) + 1) * 3600 - ahead + offset
    if seconds % 86400 == 0:
        day = F.timestamp_add("DAY", F.lit(seconds // 86400), F.date_trunc("day", local).cast("timestamp_ntz"))
        return _epoch(to_utc(day, zone)) + offset
    return (F.floor((after + ahead - offset) / seconds) + 1) * seconds + offset - ahead


def _clock(day: Column, hour: int, minute: int, zone: str) -> Column:
    return to_utc(F.timestamp_add("MINUTE", F.lit(hour * 60 + minute), day.cast("timestamp_ntz")), zone)


def calendar_next(kind: str, after: Column, hour: int = 0, minute: int = 0, weekday: int = 0, day: int = 1, month: int = 1, zone: str = "UTC") -> Column:
    """The next daily, weekly, monthly or yearly time by the zone's clock after ``after``; weekday 0 is Sunday.

    A day that a month lacks is its last one.
    """
    local = to_local(after, zone)
    at = lambda d: _clock(d, hour, minute, zone)

    def on(first: Column, months: int) -> Column:
        start = F.add_months(first, months)
        return at(F.least(F.date_add(start, day - 1), F.last_day(start)))

    def pick(now: Column, then: Column) -> Column:
        return F.when(now > after, now).otherwise(then)

    today = F.to_date(local)
    if kind == "daily":
        return pick(at(today), at(F.date_add(today, 1)))
    if kind == "weekly":
        to = F.date_add(today, F.pmod(F.lit(weekday) - (F.dayofweek(local) - 1), F.lit(7)))
        return pick(at(to), at(F.date_add(to, 7)))
    if kind == "monthly":
        first = F.trunc(local, "month")
        return pick(on(first, 0), on(first, 1))
    if kind == "yearly":
        first = F.make_date(F.year(local), F.lit(month), F.lit(1))
        return pick(on(first, 0), on(first, 12))
    raise ValueError(kind)


def scheduled_time(kind: str, at: Column, hour: int = 0, minute: int = 0, weekday: int = 0, day: int = 1, month: int = 1, seconds: int = 0, date: Column | None = None, zone: str = "UTC") -> Column:
    """The time that a run at ``at`` was scheduled for: the last one that is not after it.

    Daily, weekly, monthly and yearly ones follow the zone's clock, intervals a grid
    from the epoch; a single one is null before its ``date``. A weekly one looks six
    days back, so it is null on its own weekday before its hour. A day that a month
    lacks runs on into the next.
    """
    if kind == "interval":
        return _from_epoch(F.floor(_epoch(at) / seconds) * seconds)
    if kind == "once":
        return F.when(date <= at, date)
    local = to_local(at, zone)
    today, clock = F.to_date(local), lambda d: _clock(d, hour, minute, zone)
    not_after = lambda now, then: F.when(now <= at, now).otherwise(then)
    if kind == "daily":
        return not_after(clock(today), clock(F.date_sub(today, 1)))
    if kind == "weekly":
        found = clock(F.date_sub(today, F.pmod((F.dayofweek(local) - 1) - F.lit(weekday), F.lit(7))))
        return F.when(found <= at, found)
    if kind == "monthly":
        first = F.trunc(local, "month")
        return not_after(clock(F.date_add(first, day - 1)), clock(F.date_add(F.add_months(first, -1), day - 1)))
    if kind == "yearly":
        first = F.make_date(F.year(local), F.lit(month), F.lit(1))
        this, last = (clock(F.date_add(F.add_months(first, -12 * k), day - 1)) for k in (0, 1))
        return not_after(this, F.when(last <= at, last))
    raise ValueError(kind)


def cron_prev(times: DataFrame, at: str, c: Cron, days: int = 366) -> DataFrame:
    """``times`` with ``prev``, the last fitting time before ``at``, null if none comes within ``days`` back.

    As in ``cron_next``, only days are joined; the time within a day is a lookup.
    """
    minutes = [h * 60 + m for h in c.hours for m in c.minutes]
    exact = F.date_trunc("minute", at).cast("timestamp_ntz") == F.col(at)
    minute = F.hour(at) * 60 + F.minute(at) + F.when(exact, 0).otherwise(1)  # the first minute that is not before
    bounds = times.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    calendar = bounds.where("lo is not null").select(F.explode(F.sequence(F.date_sub(F.to_date("lo"), days), F.to_date("hi"))).alias("d")).withColumn("fits", day_matches(c, F.col("d")))
    earlier = Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    calendar = calendar.select("d", "fits", F.last(F.when(F.col("fits"), F.col("d")), ignorenulls=True).over(earlier).alias("before"))
    rows = times.withColumns({"_d": F.to_date(at), "_m": minute}).join(F.broadcast(calendar), F.col("_d") == F.col("d"), "left")
    today = F.when(F.col("fits"), F.try_element_at(F.filter(F.array(*map(F.lit, minutes)), lambda m: m < F.col("_m")), F.lit(-1)))
    at_day = lambda d, m: F.timestamp_add("MINUTE", m, d.cast("timestamp_ntz"))
    found = F.coalesce(at_day(F.col("_d"), today), at_day(F.col("before"), F.lit(minutes[-1])))
    within = F.when(found >= F.timestamp_add("DAY", F.lit(-days), F.col(at)), found)
    return rows.withColumn("prev", within).select(*times.columns, "prev")


def cron_scheduled(times: DataFrame, at: str, c: Cron) -> DataFrame:
    """``times`` with ``scheduled``, the last fitting time that is not a second or more after ``at``."""
    later = times.withColumn("_at", F.timestamp_add("SECOND", F.lit(1), F.col(at)))
    return cron_prev(later, "_at", c).withColumnRenamed("prev", "scheduled").drop("_at")


def cron_last(spark: SparkSession, c: Cron, before: Column, n: int) -> DataFrame:
    """(slot): the last ``n`` fitting times of the 366 days before ``before``."""
    return cron_slots(spark, c, F.timestamp_add("DAY", F.lit(-366), before), before, limit=366 * 1440).orderBy(F.desc("slot")).limit(n)


def cron_following(spark: SparkSession, c: Cron, after: Column, n: int, days: int = 366) -> DataFrame:
    """(slot): the first ``n`` fitting times after ``after``, within ``days``."""
    low = F.timestamp_add("MICROSECOND", F.lit(1), after)
    return cron_slots(spark, c, low, F.timestamp_add("DAY", F.lit(days), after), limit=n)


def in_zone(times: DataFrame, at: str, zone: str, found: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """What ``found`` adds as ``name`` to ``times``, reckoned by the zone's clock and given in UTC."""
    local = found(times.withColumn("_local", to_local(F.col(at), zone)), "_local")
    return local.withColumn(name, to_utc(F.col(name), zone)).drop("_local")


def once_next(after: Column, date: Column) -> Column:
    return F.when(date > after, date)


def business_next(times: DataFrame, at: str, holidays: DataFrame) -> DataFrame:
    """``times`` with ``next``: the start of the next day that is neither a weekend's nor in ``holidays`` (day).

    Holidays are looked up as an anti-join against the days that follow, two weeks at most.
    """
    ahead = times.select(at).distinct().select(at, F.explode(F.sequence(F.date_add(F.to_date(at), 1), F.date_add(F.to_date(at), 14))).alias("day")).where(~F.dayofweek("day").isin(1, 7))
    first = ahead.join(holidays.select("day").distinct(), "day", "left_anti").groupBy(at).agg(F.min("day").cast("timestamp_ntz").alias("next"))
    return times.join(first, at, "left")


def partition_time(kind: str, at: Column, seconds: int = 0) -> Column:
    """The start of the period that a time belongs to: day, week from Sunday, month, or an interval's step from the epoch.

    Times of cron, yearly, single and timetable schedules are their own period.
    """
    if kind in ("cron", "once", "yearly", "timetable"):
        return at.cast("timestamp_ntz")
    if kind == "daily":
        return F.date_trunc("day", at).cast("timestamp_ntz")
    if kind == "weekly":
        return F.date_sub(at, F.dayofweek(at) - 1).cast("timestamp_ntz")
    if kind == "monthly":
        return F.date_trunc("month", at).cast("timestamp_ntz")
    if kind == "interval":
        epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
        return F.timestamp_add("SECOND", (-F.pmod(epoch, F.lit(seconds))).cast("int"), F.date_trunc("second", at).cast("timestamp_ntz"))
    raise ValueError(kind)


def default_offset(kind: Column, seconds: Column) -> Column:
    """How far behind its run a schedule's partition lies, as an ISO-8601 duration."""
    text = lambda n, unit: F.concat(F.lit("PT"), n.cast("long").cast("string"), F.lit(unit))
    step = F.when(seconds % 3600 == 0, text(seconds / 3600, "H")).when(seconds % 60 == 0, text(seconds / 60, "M")).otherwise(text(seconds, "S"))
    return F.when(kind == "daily", "P1D").when(kind == "weekly", "P7D").when(kind == "monthly", "P1M").when(kind == "interval", step).otherwise("PT0S")


def interval_slots(schedules: DataFrame, high: Column) -> DataFrame:
    """A row for each slot of interval schedules (id, first_at, step_s, ...) before ``high``, numbered from 0."""
    last = F.least(F.floor(F.timestamp_diff("SECOND", F.col("first_at"), high - F.expr("INTERVAL 1 SECOND")) / F.col("step_s")), F.lit(MOST_SLOTS - 1))
    rows = schedules.withColumn("_last", last).where("_last >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return rows.withColumn("slot", F.timestamp_add("SECOND", F.col("k") * F.col("step_s"), F.col("first_at"))).drop("_last")


def catch_up(slots: DataFrame, as_of: Column) -> DataFrame:
    """Missed slots (id, slot, last_slot_at, accuracy) that are run now: the latest, all up to a bound, or the last N."""
    missed = slots.where((F.col("slot") <= as_of) & (F.col("last_slot_at").isNull() | (F.col("slot") > F.col("last_slot_at"))))
    back = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("slot")))
    ahead = F.row_number().over(Window.partitionBy("id").orderBy(F.asc("slot")))
    wanted = F.coalesce(F.nullif(F.regexp_extract("accuracy", r"^last:(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    rows = missed.withColumns({"_b": back, "_a": ahead})
    return rows.where(F.when(F.col("accuracy") == "all", F.col("_a") <= MOST_CATCH_UP).otherwise(F.col("_b") <= wanted)).select("id", "slot")


def backfill_plan(slots: DataFrame, backfills: DataFrame, done: DataFrame, prefix: str = "$backfill") -> DataFrame:
    """The slots that each backfill starts next: after its cursor, not there yet, as many as it has room for.

    A slot's key, prefix:id:epoch seconds, is what tells whether it is there.
    """
    key = F.concat_ws(":", F.lit(prefix), F.col("id"), F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("slot")))
    rows = slots.join(backfills.select("id", "range_start", "range_end", "cursor", "concurrency", "active"), "id")
    rows = rows.where((F.col("slot") >= F.col("range_start")) & (F.col("slot") < F.col("range_end")) & (F.col("cursor").isNull() | (F.col("slot") > F.col("cursor"))))
    fresh = rows.withColumn("key", key).join(done.select("key").distinct(), "key", "left_anti")
    order = F.row_number().over(Window.partitionBy("id").orderBy("slot"))
    return fresh.withColumn("_k", order).where(F.col("_k") <= F.col("concurrency") - F.col("active")).select("id", "slot", "key")


def upcoming(slots: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """Each schedule's next ``limit`` slots from ``as_of`` on."""
    order = F.row_number().over(Window.partitionBy("id").orderBy("slot"))
    return slots.where(F.col("slot") >= as_of).withColumn("pos", order.cast("long")).where(F.col("pos") <= limit)


def partition_grid(slots: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """What became of each slot: its latest run's state, MISSING or UPCOMING; and the share of its day that is complete."""
    last = runs.groupBy("id", "slot").agg(F.max_by("state", F.struct("created_at", "run_id")).alias("_state"))
    state = F.coalesce("_state", F.when(F.col("slot") > as_of, "UPCOMING").otherwise("MISSING"))
    rows = slots.select("id", "slot").join(last, ["id", "slot"], "left").select("id", "slot", F.to_date("slot").alias("day"), state.alias("state"))
    due = F.count(F.when(F.col("state") != "UPCOMING", 1)).over(Window.partitionBy("id", "day"))
    done = F.count(F.when(F.col("state") == "COMPLETED", 1)).over(Window.partitionBy("id", "day"))
    return rows.withColumn("complete", F.when(due > 0, done / due))
