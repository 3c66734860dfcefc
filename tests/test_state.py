from pyspark.sql import functions as F

from grovespark.plans.state import cut


def joined(left, right):
    out = left.join(right, "k").groupBy("one", "two").count()
    count = out.collect()[0]["count"]
    return count, out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_broadcasts_follow_measured_sizes(spark):
    """100000 rows of 200 characters take far more than the threshold of 10 MB, their file far less."""

    def wide(n, name):
        return cut(spark.range(n).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 200).alias(name)))

    count, plan = joined(wide(100_000, "one"), wide(100_000, "two"))
    assert count == 100_000 and "BroadcastHashJoin" not in plan
    count, plan = joined(wide(100, "one"), wide(100_000, "two"))
    assert count == 100 and "BroadcastHashJoin" in plan
