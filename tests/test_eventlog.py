import datetime

import pytest
from pyspark.sql import functions as F

from careloom.operators import eventlog as E
from conftest import rows

T0 = datetime.datetime(2020, 1, 1)


def log(spark, cases):
    data = [(c, a, T0 + datetime.timedelta(days=d), i)
            for c, steps in cases.items() for i, (a, d) in enumerate(steps)]
    return spark.createDataFrame(data, "case_id string, activity string, ts timestamp_ntz, event_id int")


CASES = {
    "first": [("ICD:T", 0), ("DRUG:a", 1)],
    "none": [("DRUG:a", 0), ("DRUG:b", 3)],
    "two": [("DRUG:a", 0), ("DRUG:b", 2), ("ICD:T", 5), ("CPT:x", 5), ("ICD:T", 9)],
    "same": [("DRUG:a", 0), ("ICD:T", 0), ("DRUG:c", 0)],
}


def test_split_at_first_target(spark):
    df = log(spark, CASES)
    pre = E.split_at_first_target(df, ["T"], ["event_id"], "pre")
    post = E.split_at_first_target(df, ["T"], ["event_id"], "post")
    strict = E.split_at_first_target(df, ["T"], ["event_id"], "pre", include_target=False)
    assert rows(pre.select("case_id", "event_id")) == [
        ("first", 0), ("same", 0), ("same", 1), ("two", 0), ("two", 1), ("two", 2)]
    assert rows(post.select("case_id", "event_id")) == [("first", 1), ("same", 2), ("two", 3), ("two", 4)]
    assert strict.count() == pre.count() - 3
    # pre and post together are all events of the cases with a target
    assert pre.count() + post.count() == df.filter("case_id <> 'none'").count()


def test_time_to_event(spark):
    pre = E.split_at_first_target(log(spark, CASES), ["T"], ["event_id"])
    got = {r["case_id"]: r for r in E.time_to_event(pre, (3, 30)).collect()}
    assert got["two"]["time_to_target_days"] == 5.0
    assert (got["two"]["n_events_3d"], got["two"]["n_drug_events_3d"], got["two"]["n_drug_events_30d"]) == (2, 1, 2)
    last = {r["case_id"]: r for r in E.last_item_before_target(pre, "DRUG:", ["event_id"], (3,)).collect()}
    assert (last["two"]["last_code"], last["two"]["days_from_last"], last["two"]["n_unique_3d"]) == ("b", 3.0, 1)


def test_counts(spark):
    got = {r["case_id"]: tuple(r)[1:] for r in E.case_counts(log(spark, CASES)).collect()}
    assert got["two"] == (5, 2, 2, 1, 4)


def test_traces_ignore_case_size_and_buckets(spark):
    cases = {f"c{i}": [("a", 0), ("b", i % 4), ("a", 5)] for i in range(6)}
    cases |= {"d1": [("b", 0), ("a", 1), ("a", 2)], "d2": [("a", 0)]}
    found = E.traces(log(spark, cases), ["event_id"])
    assert rows(found.select("trace_id", "length", "absolute_frequency")) == [("c0", 3, 6), ("d1", 3, 1), ("d2", 1, 1)]
    steps = E.trace_steps(log(spark, cases), found, ["event_id"])
    assert rows(steps.filter("trace_id = 'd1'").select("event_index", "activity")) == [(1, "b"), (2, "a"), (3, "a")]
    shown = E.trace_explorer(found, 0.8)
    assert sorted(r["trace_id"] for r in shown.collect()) == ["c0", "d1"]


def test_matrix_follows_every_case(spark):
    df = log(spark, CASES)
    matrix = E.process_matrix(df, ["event_id"])
    total = matrix.agg(F.sum("n")).first()[0]
    assert total == df.count() + len(CASES)
    follows = {(r[0], r[1]): r[2] for r in E.directly_follows(df, ["event_id"]).collect()}
    assert follows[("DRUG:a", "DRUG:b")] == 2 and follows[("ICD:T", "CPT:x")] == 1
    assert sum(follows.values()) == df.count() - len(CASES)


def test_event_log_ids_survive_recomputation(spark):
    events = spark.createDataFrame([("p", 1, "d", "NA", ""), ("p", 2, None, "F1", "x")],
                                   "person string, id int, drug string, dx string, px string")
    events = events.withColumn("day", F.lit("2020-01-01").cast("date"))
    make = lambda df: E.event_log(df, "person", "day", ["id"], "drug", ["dx"], ["px"])
    got = rows(make(events).select("activity", "activity_instance_id"))
    assert got == [("CPT:x", "2#px"), ("DRUG:d", "1#drug"), ("ICD:F1", "2#dx")]
    assert rows(make(events.repartition(4)).select("activity", "activity_instance_id")) == got


def test_allowed_codes(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["b"],)], "items array<string>")
    assert rows(E.allowed_codes(sets, "items", ["F1120"])) == [("F1120",), ("a",), ("b",)]


@pytest.mark.parametrize("operator", ["index", "next"])
def test_a_hot_day_of_a_case_is_many_tasks(spark, operator):
    """Nine tenths of the rows on one case, day and time, told apart by an id only."""
    log = spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("case_id"),
        F.lit("2020-01-01 00:00:00").cast("timestamp").alias("ts"), F.col("id"), F.concat(F.lit("A"), F.col("id") % 7).alias("activity"),
    ).repartition(8)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # a few kilobytes would be merged into one task
    try:
        out = E.with_event_index(log, ["id"]) if operator == "index" else E._with_next(log, ["id"], None)
        tasks = out.filter("case_id = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(merge, "true")
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 2700 / 2
    if operator == "index":
        hot = [r["event_index"] for r in out.filter("case_id = 'hot'").orderBy("id").collect()]
        assert hot == list(range(1, 2701))
