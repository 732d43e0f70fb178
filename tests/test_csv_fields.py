import random

from pyspark.sql import functions as F

from flowlens.sources import wells


def test_fields_are_cut_where_the_pattern_cuts_them(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice(['"', ",", ",", "a", " ", wells.MARK if n % 9 == 0 else "b"]) for _ in range(rng.randint(0, 24))) for n in range(3000)]
    rows = spark.createDataFrame([(x,) for x in lines], "l string")
    cut = rows.select(wells._fields(F.col("l")).alias("got"), F.split("l", wells._COMMA, -1).alias("want"))
    assert cut.where("got is distinct from want").count() == 0


def test_line_with_many_quotes(spark):
    comment = "".join(f'""{i}"", ' for i in range(20_000))
    line = ",".join(["1", "S1", "2026-03-19", *[""] * 15, f'"{comment}"'])
    got = wells.parse_lines(spark.createDataFrame([(line,), (line + "\r",)], "value string")).collect()
    assert [r.msmt_cmt for r in got] == [comment.replace('""', '"').strip()] * 2
