"""Relative-error quantile sketches as plain rows, and smoothed rates.

A sketch is a table of (keys..., bin, n): merging sketches is adding up their rows,
so that it is built with a partial aggregate on each partition and never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error, and the ratio of neighbouring bins that gives it.
EPSILON = 0.02
GAMMA = (1 + EPSILON) / (1 - EPSILON)


def sketch_bin(value: Column) -> Column:
    """ceil(log of the value to base GAMMA); null for what isn't positive."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("int"))


def bin_value(bin_: Column) -> Column:
    return F.pow(F.lit(GAMMA), bin_ - F.lit(0.5))


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bin, n, least, most): counts by bin with each bin's exact extremes. Values <= 0 and nulls are ignored."""
    v = F.col(value).cast("double")
    return df.where(v > 0).groupBy(*keys, sketch_bin(v).alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))


def merge(*sketches: DataFrame, keys: list[str]) -> DataFrame:
    rows = sketches[0]
    for s in sketches[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def quantiles(sketches: DataFrame, keys: list[str], qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Estimates of each key's quantiles: the bin that holds rank ceil(q * n), its middle held to the extremes.

    0 and 1 give the exact least and most. Windows run over a key's bins, of which
    there are a few hundred at most, not over its values.
    """
    over = Window.partitionBy(*keys)
    rows = sketches.withColumns({"_cum": F.sum("n").over(over.orderBy("bin")), "_all": F.sum("n").over(over), "_lo": F.min("least").over(over), "_hi": F.max("most").over(over)})
    rank = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("_all")), F.lit(1))
    pick = lambda q: F.min(F.when(F.col("_cum") >= rank(q), F.least(F.greatest(bin_value(F.col("bin")), F.col("_lo")), F.col("_hi"))))
    out = [F.min("_lo") if q <= 0 else F.max("_hi") if q >= 1 else pick(q) for q in qs]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *[e.alias(f"p{q * 100:g}".replace(".", "_")) for q, e in zip(qs, out)])


def mean(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg((F.sum(bin_value(F.col("bin")) * F.col("n")) / F.sum("n")).alias("mean"))


def weighted_median(medians: DataFrame) -> DataFrame:
    """The count-weighted mean of medians (columns n, p50), which stands for an average duration."""
    return medians.agg((F.sum(F.col("p50") * F.col("n")) / F.sum("n")).alias("avg_ms"))


def smoothed_rate(counts: DataFrame, key: str, order: str, count: str, seconds: float, alpha: float = 0.25) -> DataFrame:
    """Each key's exponentially smoothed rate after each cycle.

    The raw rate is count / max(seconds, 1); the first one seeds the average. Counts
    hold a row for each cycle, silent ones with 0. A cycle's value needs all before it,
    so a key's cycles are put in order in one array: as long as its cycles are many.
    """
    raw = F.col(count) / F.lit(max(seconds, 1.0))
    rows = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), raw.alias("raw")))).alias("l"))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["at"].alias("at"), F.when(F.size(acc) == 0, x["raw"]).otherwise(F.lit(alpha) * x["raw"] + F.lit(1 - alpha) * F.element_at(acc, -1)["rate"]).alias("rate"))))
    none = F.array().cast(f"array<struct<at: {counts.schema[order].dataType.simpleString()}, rate: double>>")
    return rows.select(key, F.explode(F.aggregate("l", none, step)).alias("x")).select(key, F.col("x.at").alias(order), F.col("x.rate").alias("rate"))
