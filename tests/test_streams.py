"""Streamed queries leave their results with the executors."""

from pyspark.sql import functions as F

from rimeframe.plans import tracking as P


def test_results_do_not_go_through_the_driver(spark):
    for query in (P.stream_latest, P.stream_windowed):
        got = query(spark, "/root/testdata/sf0.001")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan and "MemoryPlan" not in plan and got.inputFiles()
        assert got.agg(F.count("*")).first()[0] > 0
