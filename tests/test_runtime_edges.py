from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codeweft.operators import ledger as L
from codeweft.queries.tables import QUERIES


def test_repeated_static_edges_are_not_met_again_for_each_runtime_edge(spark, rows):
    """with a constant in the edge, a join walked all static rows of a source for each runtime edge of it."""
    static = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").alias("source"), F.lit("view").alias("target"), F.lit("calls").alias("kind"))
    seen = spark.createDataFrame([("a", "view"), ("a", "b"), ("a", "b"), ("b", "view")], "source string, target string").withColumn("kind", F.lit("calls"))
    got = L.merge_runtime(static, seen)
    assert rows(got) == [(None, "view", "calls", "static"), ("a", "b", "calls", "runtime"), ("a", "view", "calls", "static"), ("b", "view", "calls", "runtime")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_events_without_a_type_make_no_runtime_edge(spark, rows, tmp_path):
    kinds = ["a", None, "b", "view", "c", None]
    e = [(i, datetime(2025, 1, 1) + timedelta(seconds=i), 1, k) for i, k in enumerate(kinds)]
    spark.createDataFrame(e, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    static = [(k, "view", "calls", "static") for k in (None, "a", "b", "c", "view")]
    assert rows(QUERIES["runtime_edge_merge"](spark, str(tmp_path))) == sorted([*static, ("view", "c", "calls", "runtime")], key=lambda r: tuple((x is not None, str(x)) for x in r))
