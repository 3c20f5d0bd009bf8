"""What a reviewer found on larger tables."""

import random

from factloom.operators import ivf


def test_what_is_asked_of_blocks_does_not_go_through_the_driver(spark):
    """Packed, the queries of all blocks are small, so they were joined by a broadcast of all their rows."""
    rng = random.Random(7)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    search = ivf.Search(ivf.build(vectors), queries, 5)
    search.found.collect()
    plan = search.found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
