import datetime

from careloom.operators import compare as P
from careloom.operators import frequency as Q
from careloom.operators import quality as Z
from conftest import rows

D = datetime.date


def cohort(spark, data):
    return spark.createDataFrame(
        data, "person int, event_type string, event_date date, event_year int, age int, age_band string, "
        "is_target_case int, first_target_date date, days_to_target_event int, cohort_name string, "
        "cohort string, target int, drug_name string")


def good(person, case, kind="medical", days=None):
    return (person, kind, D(2016, 5, 1), 2016, 30, "25-44", case, D(2016, 5, 1) if case else None, days,
            "opioid_ed", "X", 1, "d")


def test_clean_cohort_passes(spark):
    data = [good(0, 1)] + [good(i, 0) for i in range(1, 6)] + [good(0, 1, "pharmacy", 30)]
    checks = Z.cohort_qa(cohort(spark, data))
    status = Z.partition_status(checks).first()
    assert status["status"] == "PASS" and status["failed_checks"] == 0
    values = {r["check"]: r["value"] for r in checks.collect()}
    assert values["cases"] == 1 and values["controls"] == 5 and values["control_case_ratio"] == 5.0


def test_each_fault_is_found(spark):
    base = [good(0, 1)] + [good(i, 0) for i in range(1, 6)]
    bad = list(good(9, 0, "pharmacy", 31))
    bad[3], bad[4], bad[5], bad[7] = 2017, 130, "25-44", D(2016, 1, 1)
    wrong = list(good(0, 0))
    wrong[3], wrong[9], wrong[1] = 2017, "other", None
    checks = Z.cohort_qa(cohort(spark, base + [tuple(bad), tuple(wrong)]), by=["cohort_name"])
    failed = {r["check"] for r in checks.filter("status = 'FAIL'").collect()}
    assert {"outside_window", "year_mismatch", "age_out_of_range", "age_outside_band",
            "control_with_first_date", "invalid_cohort_name", "null_event_type"} <= failed


def test_ratio_warns_and_mixed_labels_fail(spark):
    few = Z.cohort_qa(cohort(spark, [good(0, 1), good(1, 0)]))
    assert Z.partition_status(few).first()["status"] == "WARN"
    mixed = Z.cohort_qa(cohort(spark, [good(0, 1), good(0, 0)]))
    assert "mixed_labels" in {r["check"] for r in mixed.filter("status = 'FAIL'").collect()}


def test_stage_checks(spark):
    df = spark.createDataFrame([("p", "20160101", 2016, "0-12", " "), (None, "20170101", 2016, "zz", "x")],
                               "person string, day string, y int, band string, drug string")
    args = (["person", "missing"], ["person", "drug"], "day", "y", "band")
    out = Z.roll_up(Z.stage_checks(df, *args)).first()
    assert out["overall_status"] == "FAIL" and out["passing_validations"] == 0
    assert out["critical_issues"] == "age_bands; date_quality; missing_data; schema"
    ok = Z.roll_up(Z.stage_checks(df.limit(0), ["person"], ["person"], "day", "y", "band")).first()
    assert ok["total_validations"] == 4


def test_blank_and_null_counts(spark):
    df = spark.createDataFrame([(" ",), ("",), ("7",), (None,), ("x",)], "age string")
    assert rows(Z.blank_check(df, {"age": "int"})) == [("age", 5, 1, 1, 4)]
    assert rows(Z.null_check(df, ["age"])) == [("age", 3)]


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1), (3, "a", 9)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 1), (3, "a", 9)], "k int, s string, n int")
    assert rows(P.snapshot_diff(a, b, "k", ["s", "n"])) == [(2, "changed", "n"), (3, "changed", "s,n")][:1] + [(4, "added", None)]


def test_totals(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("y", 5), ("z", 1)], "k string, n int")
    assert rows(P.compare_totals(a, b, "k", "n")) == [("x", 1, 0, -1), ("y", 2, 5, 3), ("z", 0, 1, 1)]


def test_upper_middle_median_over_a_dense_grid(spark):
    counts = spark.createDataFrame([("a", 2016, 4), ("a", 2017, 10)], "b string, y int, n bigint")
    out = Q.target_average_stats(counts, "n", ["b", "y"], {"b": ["a", "z"], "y": [2016, 2017, 2018]}).first()
    assert (out["total_partitions"], out["partitions_with_zero"], out["median"], out["average"]) == (6, 4, 10, 7.0)


def test_cooccurrence_counts_row_pairs(spark):
    left = spark.createDataFrame([(1, "a")] * 300 + [(1, "b"), (2, "a")], "c int, l string")
    right = spark.createDataFrame([(1, "x")] * 200 + [(2, "y")], "c int, r string")
    got = rows(Q.co_occurrence(left, right, ["c"], "l", "r"))
    assert got == [("a", "x", 60000), ("a", "y", 1), ("b", "x", 200)]


def test_range_buckets_are_half_open(spark):
    df = spark.createDataFrame([(0,), (4,), (5,), (998,), (999,), (-1,), (None,)], "v int")
    got = [r[0] for r in df.select(Q.range_bucket("v", [0, 5, 999])).collect()]
    assert got == ["0-5", "0-5", "5-999", "5-999", None, None, None]


def test_mid_frequency(spark):
    df = spark.createDataFrame([(f"i{i:02d}", 100 - i // 2) for i in range(20)], "item string, frequency bigint")
    got = Q.mid_frequency(df, "item", 2).orderBy("frequency_rank").collect()
    assert [r["item"] for r in got] == ["i07", "i08", "i09", "i10", "i11"]


def test_partition_presence(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "b string, y int")
    out = Z.partition_presence(df, {"b": ["a", "c"], "y": [1]})
    assert rows(out) == [("a", 1, 2, True), ("c", 1, 0, False)]
