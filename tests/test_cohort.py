import datetime

import pytest
from pyspark.sql import functions as F

from careloom.operators import cohort as K
from careloom.operators.mapping import rows_with_code
from conftest import rows

D = datetime.date


def events(spark, data):
    return spark.createDataFrame(
        data, "person int, event_date date, event_type string, code string, hcg_line string")


def crowd(spark, cases, controls):
    data = [(i, D(2016, 1, 1), "medical", "T" if i < cases else "N", None) for i in range(cases + controls)]
    return events(spark, data)


@pytest.mark.parametrize("cases,controls,expected", [(0, 20, 0), (3, 9, 9), (3, 40, 15)])
def test_five_controls_per_case(spark, cases, controls, expected):
    out = K.case_control_cohort(crowd(spark, cases, controls), F.col("code") == "T")
    people = out.groupBy("person").agg(F.max("is_target_case").alias("c")).collect()
    assert sum(r["c"] == 1 for r in people) == cases
    assert sum(r["c"] == 0 for r in people) == expected


def test_sample_does_not_depend_on_partitions(spark):
    df = crowd(spark, 4, 60)
    picks = [
        {r["person"] for r in K.case_control_cohort(x, F.col("code") == "T").collect()}
        for x in (df, df.repartition(7), df.coalesce(1))
    ]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 24


def test_labels_and_dates(spark):
    df = events(spark, [(1, D(2016, 5, 1), "medical", "T", None), (1, D(2016, 3, 1), "medical", "T", None),
                        (2, D(2016, 1, 1), "pharmacy", "N", None)])
    got = {r["person"]: r for r in K.case_control_cohort(df, F.col("code") == "T").collect()}
    assert got[1]["first_target_date"] == D(2016, 3, 1) and got[1]["cohort"] == "OPIOID_ED"
    assert got[2]["first_target_date"] is None and got[2]["cohort"] == "NON_ED" and got[2]["target"] == 1


def test_window_keeps_drugs_of_thirty_days(spark):
    ref = D(2016, 6, 30)
    days = [-1, 0, 30, 31]
    data = [(1, ref, "medical", "T", None)]
    data += [(1, ref - datetime.timedelta(days=d), "pharmacy", None, None) for d in days]
    out = K.windowed_cohort(events(spark, data), F.col("code") == "T", F.col("code") == "X")
    drugs = sorted(r["days_to_target_event"] for r in out.filter("event_type = 'pharmacy'").collect())
    assert drugs == [0, 30]


def test_excluded_persons_are_neither_cases_nor_controls(spark):
    data = [(1, D(2016, 1, 1), "medical", "T", None), (2, D(2016, 1, 1), "medical", "T", None),
            (2, D(2016, 2, 1), "medical", "X", None), (3, D(2016, 1, 1), "medical", "X", None),
            (4, D(2016, 1, 1), "medical", "N", None)]
    df = events(spark, data)
    out = K.windowed_cohort(df, F.col("code") == "T", F.col("code") == "X")
    assert {r["person"] for r in out.collect()} == {1, 4}
    assert K.cohort_exclusivity(out, df, F.col("code") == "X").first()["passed"]
    assert not K.cohort_exclusivity(df, df, F.col("code") == "X").first()["passed"]


def test_control_reference_date(spark):
    # 2: first medical without target, 3: pharmacy only
    data = [(1, D(2016, 1, 1), "medical", "T", None),
            (2, D(2016, 3, 10), "medical", "N", None), (2, D(2016, 3, 1), "pharmacy", None, None),
            (2, D(2016, 3, 20), "pharmacy", None, None),
            (3, D(2016, 4, 1), "pharmacy", None, None), (3, D(2016, 4, 2), "pharmacy", None, None)]
    out = K.windowed_cohort(events(spark, data), F.col("code") == "T", F.lit(False))
    got = rows(out.filter("event_type = 'pharmacy'").select("person", "days_to_target_event"))
    assert got == [(2, 9), (3, 0)]


def test_control_only(spark):
    out = K.control_only_cohort(crowd(spark, 0, 30), F.col("code") == "T", ratio=5, average_targets=2)
    assert out.count() == 10 and out.filter("target <> 0 or is_target_case <> 0").count() == 0
    assert K.control_only_cohort(crowd(spark, 0, 30), F.col("code") == "T", average_targets=None).count() == 30


def classify(spark, data, **kw):
    df = spark.createDataFrame(data, "p string, t string, hcg_line string")
    return [r["event_classification"] for r in K.classify_event(df, ["p", "t"], cpt_slots=["t"], **kw).collect()]


def test_classification_defaults(spark):
    data = [("F1120", None, None), ("A", "F11.20", None), ("A", None, "O11 - Emergency Room"), ("A", None, None)]
    assert classify(spark, data) == ["opioid_ed", "opioid_ed", "ed_non_opioid", "ed_non_opioid"]
    assert classify(spark, data, else_label="non_target")[-1] == "non_target"


def test_classification_by_targets(spark):
    data = [("F1120", None, None), ("A", "F1120", None), ("F11.9", None, "O11 - Emergency Room"), ("A", "99x", None)]
    assert classify(spark, data, codes=["F1120"]) == ["target", "non_target", "ed_non_opioid", "non_target"]
    assert classify(spark, data, prefixes=["f11."]) == ["target", "non_target", "target", "non_target"]
    assert classify(spark, data, cpt_prefixes=["99%"])[3] == "target"


def test_event_fact_numbers_each_source(spark):
    med = spark.createDataFrame([(1, D(2016, 1, 2), "a"), (1, D(2016, 1, 1), "b"), (1, D(2016, 1, 1), "")],
                                "person int, event_date date, code string")
    ph = spark.createDataFrame([(1, D(2016, 1, 3), "d"), (1, D(2016, 1, 4), None)],
                               "person int, event_date date, drug string")
    out = K.event_fact(med, ph, "code", "drug", order=["event_date", "code"])
    assert rows(out.select("event_type", "event_sequence", "code", "drug")) == [
        ("medical", 1, "b", None), ("medical", 2, "a", None), ("pharmacy", 1, None, "d")]


def test_model_events_and_ratio(spark):
    cohort = spark.createDataFrame(
        [(i, "x" if i % 2 else "y", int(i < 2)) for i in range(40)], "person int, code string, is_target_case int")
    items = spark.createDataFrame([("x",)], "item string")
    out = K.model_events(cohort, items, ["code"], ratio=5)
    assert out.filter("is_target_case = 1").count() == 1 and out.filter("is_target_case = 0").count() == 5


def test_rebuild_list(spark):
    data = [("a", i, int(i == 0)) for i in range(8)] + [("b", i, int(i < 2)) for i in range(6)]
    df = spark.createDataFrame(data, "part string, person int, is_target_case int")
    assert [r["part"] for r in K.cohort_checks(df, ["part"]).collect()] == ["a"]


def test_short_code_lists_move_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "", "c"), (4, None, None), (5, "c", "a")], "k int, s string, u string")
    wanted = spark.createDataFrame([("a",), ("c",), ("c",), ("",), (None,)], "code string")
    found = rows_with_code(df, ["s", "u"], wanted)
    assert rows(found) == [(1, "a", "x"), (3, "", "c"), (5, "c", "a")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(rows_with_code(df, ["s", "u"], wanted)) == rows(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
