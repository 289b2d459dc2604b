"""The copies of the queries for all slots must not pass through the driver."""

from pyspark.sql import functions as F

from datasteward.llm import vector_search


def test_copies_of_queries_are_not_broadcast(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    found = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [slot" in plan and "Broadcast" not in plan
    assert found.count() == 6
