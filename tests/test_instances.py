from pyspark.sql import functions as F

from careloom.operators import eventlog as E
from conftest import rows


def test_repeated_instances_count_once(spark):
    data = [("p", "a", 1, "1#x"), ("p", "a", 1, "1#x"), ("p", "a", 1, "1#y"), ("p", "a", 2, "2#x"), ("q", None, 2, "2#x")]
    log = spark.createDataFrame(data, "case_id string, activity string, claim int, activity_instance_id string")
    got = rows(E.instance_counts(log, ["case_id", "activity"], ["claim"]))
    assert got == [("p", "a", 4, 3), ("q", None, 1, 1)]


def test_instances_are_counted_where_a_join_left_them(spark):
    log = spark.range(100).select(
        (F.col("id") % 7).alias("case_id"), (F.col("id") % 40).alias("claim"), F.concat_ws("#", F.col("id") % 40, F.lit("x")).alias("activity_instance_id"),
    ).repartition(8, "claim")
    out = E.instance_counts(log, ["case_id"], ["claim"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the one above and that of the sums
    assert rows(out) == rows(log.groupBy("case_id").agg(F.count(F.lit(1)), F.countDistinct("activity_instance_id")))
