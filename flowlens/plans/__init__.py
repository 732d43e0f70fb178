"""Named queries over the test tables, each with SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.plans import dispatch, listing, metrics, schedules, streams, traces

ALL = {name: pair for module in (metrics, listing, dispatch, traces, schedules, streams) for name, pair in module.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
