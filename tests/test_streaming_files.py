"""Streams over tables of several files whose times overlap lose no row."""

import duckdb
import pytest

from flowlens import plans

from .oracle import same


@pytest.mark.parametrize("name", ["throughput_stream", "timing_buffer"])
def test_files_that_overlap_in_time(spark, tiny, tmp_path, name):
    folder = tmp_path / "events.parquet"
    rows = spark.read.parquet(f"{tiny}/events.parquet")
    last_first = rows.orderBy(rows.ts.desc()).limit(rows.count() // 2)
    for part in (last_first, rows.exceptAll(last_first).where("event_id % 2 = 0"), rows.exceptAll(last_first).where("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{folder}/*.parquet'")
    same(spark, con, str(tmp_path), plans.queries()[name], plans.oracle_sql()[name])
