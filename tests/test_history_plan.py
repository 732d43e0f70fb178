from flowlens import plans


def test_history_reads_runs_once_and_shuffles_them_once(spark, tiny):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.queries()["history_spans"](spark, tiny)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("FileScan parquet [l_orderkey" in x for x in plan.splitlines()) == 1
    assert not any("Exchange hashpartitioning(task_id" in x and "kind" in x for x in plan.splitlines())
