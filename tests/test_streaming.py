from datetime import datetime, timedelta

from flowlens.streaming import metrics as M

T0 = datetime(2024, 1, 1)


def run(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_smoothed_rates_with_a_silent_cycle(spark, tmp_path):
    rows = [("a", T0, 10), ("a", T0 + timedelta(seconds=5), 20), ("a", T0 + timedelta(seconds=15), 0)]
    spark.createDataFrame(rows, "k string, at timestamp, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp, n long").parquet(str(tmp_path / "in"))
    got = [round(r.rate, 6) for r in sorted(run(spark, M.smoothed_rates(stream, "k", 5.0), "rates"), key=lambda r: r.at)]
    assert got == [2.0, 2.5, round(2.5 * 0.75 * 0.75, 6)]


def test_waking_once_and_timing_out(spark, tmp_path):
    schema = "queue string, name string, ts timestamp, wait_id long, predicate string, timeout_at timestamp, event_id long, payload string"
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("q", "e", at(0), 1, '{"k": 1}', None, None, None), ("q", "e", at(1), 2, "{}", at(5), None, None), ("q", "e", at(10), None, None, None, 7, '{"k": 1, "x": 2}'), ("q", "e", at(11), None, None, None, 8, '{"k": 1}')]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r.wait_id, r.event_id, r.outcome) for r in run(spark, M.waking(stream), "woken")}
    assert got == {(1, 7, "EVENT"), (2, None, "TIMED_OUT")}
