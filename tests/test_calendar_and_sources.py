"""Times by a zone's clock, cron backwards, lookups and CSV lines, by hand-written values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowlens.operators import listing as L
from flowlens.operators import schedules as C
from flowlens.sources import wells

NY = "America/New_York"


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def epoch(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds())


@pytest.mark.parametrize(
    ("after", "seconds", "offset", "zone", "want"),
    [
        ("2024-10-26 12:00:00", 14 * 86400, 0, NY, "2024-11-09 05:00:00"),  # 00:00 in winter
        ("2024-10-26 12:00:00", 7 * 86400, 0, NY, "2024-11-02 04:00:00"),  # 00:00 in summer still
        ("2024-03-05 12:00:00", 7 * 86400, 3600, NY, "2024-03-12 05:00:00"),
        ("2024-01-01 00:10:00", 3600, 0, "Asia/Kolkata", "2024-01-01 00:30:00"),
        ("2024-01-01 00:10:00", 3600, 2700, "UTC", "2024-01-01 01:45:00"),
        ("2024-01-01 00:10:00", 5400, 2700, "UTC", "2024-01-01 00:45:00"),
    ],
)
def test_intervals_by_a_zones_clock(spark, after, seconds, offset, zone, want):
    assert one(spark, C.interval_next(F.lit(epoch(after)), seconds, offset, zone)) == epoch(want)


def test_days_keep_their_hour_over_summer_time(spark):
    got = [one(spark, C.calendar_next("daily", ts(t), hour=9, zone=NY)) for t in ("2024-11-02 12:00:00", "2024-11-02 13:00:00", "2024-03-09 15:00:00")]
    assert got == [datetime(2024, 11, 2, 13), datetime(2024, 11, 3, 14), datetime(2024, 3, 10, 13)]
    assert one(spark, C.scheduled_time("daily", ts("2024-11-03 13:30:00"), hour=9, zone=NY)) == datetime(2024, 11, 2, 13)
    assert one(spark, C.scheduled_time("weekly", ts("2024-01-03 07:00:00"), hour=8, weekday=3)) is None
    assert one(spark, C.scheduled_time("monthly", ts("2024-03-02 00:00:00"), day=31)) == datetime(2024, 3, 2)  # February's 31st
    assert one(spark, C.scheduled_time("once", ts("2024-03-02 00:00:00"), date=ts("2024-03-03 00:00:00"))) is None


def test_cron_backwards(spark):
    times = spark.createDataFrame([(datetime(2024, 3, 11, 9, 0),), (datetime(2024, 3, 11, 9, 0, 1),), (datetime(2024, 3, 11, 8, 59, 59, 500000),)], "at timestamp_ntz")
    nine = C.cron("0 9 * * 1-5")
    assert {r["at"]: r.prev for r in C.cron_prev(times, "at", nine).collect()} == {datetime(2024, 3, 11, 9, 0): datetime(2024, 3, 8, 9), datetime(2024, 3, 11, 9, 0, 1): datetime(2024, 3, 11, 9), datetime(2024, 3, 11, 8, 59, 59, 500000): datetime(2024, 3, 8, 9)}
    assert {r.scheduled for r in C.cron_scheduled(times, "at", nine).collect()} == {datetime(2024, 3, 11, 9)}
    assert [r.prev for r in C.cron_prev(times, "at", C.cron("0 0 1 1 * 1999")).collect()] == [None] * 3
    assert [r.slot.day for r in C.cron_last(spark, nine, ts("2024-03-11 09:00:00"), 2).collect()] == [8, 7]
    assert [r.slot.day for r in C.cron_following(spark, nine, ts("2024-03-08 09:00:00"), 2).collect()] == [11, 12]
    zoned = C.in_zone(times, "at", NY, lambda t, at: C.cron_next(t, at, nine), "next")
    assert {r.next for r in zoned.collect()} == {datetime(2024, 3, 11, 13)}


def test_lookups_name_their_namespace(spark):
    rows = spark.createDataFrame([(1, "a", "q", "k"), (1, "b", "q", "k"), (2, "a", "q", None)], "id long, namespace_id string, queue string, key string")
    assert L.lookup(rows, 1, "b").count() == 1 and L.lookup(rows, 3).count() == 0
    runs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "task_id long, attempt long")
    assert [tuple(r) for r in L.workflow_by_key(rows.where("namespace_id = 'a'"), runs, "q", "k").collect()] == [(1, 2)]
    assert L.workflow_by_key(rows, runs, "q", "other").collect() == []


def test_predicates_of_one_leaf(spark):
    rows = spark.createDataFrame([('a"b\n', True, None)], "s string, b boolean, n int")
    got = rows.select(L.predicate("x.y", F.col("s")).alias("s"), L.predicate("x", F.col("b")).alias("b"), L.predicate("x", F.col("n")).alias("n")).first()
    assert tuple(got) == ('{"x":{"y":"a\\"b\\n"}}', '{"x":true}', '{"x":null}')


def test_csv_lines(spark):
    full = ["1", " S1 ", "2026-03-19T00:00:00", "", "1.5", "abc", "12.3456", '"Good, ""very"""', '""', "m", "a", "o", "", "p", "b", '" Kern "', "u", "src", "note"]
    lines = [",".join(full), ",".join(full[:18]), ",".join(full[:17]), ",".join(["2", " ", *full[2:]]), ",".join(["3", "S3", "", *full[3:]]), "", None, ",".join(wells.COLUMNS), ",".join(["4", "S4", "soon", *full[3:]]) + "\r"]
    got = {r._id + str(r.msmt_cmt): r for r in wells.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {"1note", "1None", "4note"} and got["4note"].msmt_date is None
    r = got["1note"]
    assert (r.site_code, r.msmt_date, r.wlm_rpe, r.wlm_gse, r.gwe, r.gse_gwe) == ("S1", date(2026, 3, 19), None, Decimal("1.5"), None, Decimal("12.346"))
    assert (r.wlm_qa_desc, r.wlm_qa_detail, r.county_name) == ('Good, "very"', None, "Kern")
