from pyspark.sql import functions as F

from careloom.constants import (
    EXCLUDED_CODES, MEDICAL_HEADER, MEDICAL_REPAIR_HEADER, OPIOID_CODES, PHARMACY_HEADER,
)
from careloom.functions import columns as C
from careloom.functions import drugs as D
from careloom.operators.projection import (
    null_filled_select, repair_shifted_fields, select_or_null, snake_case, snake_case_columns,
)


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_age_band_edges(spark):
    ages = ["", "NULL", " 12 ", "0", "12", "13", "114", "115", "-1", "abc", None]
    assert apply(spark, C.age_band, ages) == [
        "Other", "Other", "0-12", "0-12", "0-12", "13-24", "95-114", "Other", "Other", "Other",
        "Other",
    ]


def test_clean_int(spark):
    assert apply(spark, C.clean_int, ["", "null", " 12 ", "abc", None, "-1"]) == [
        None, None, 12, None, None, -1]


def test_dates(spark):
    days = ["20160101", "20161301", "2016010", " ", None, "20151231", "20210101", "20200229"]
    years = apply(spark, C.event_year, days)
    assert years == [2016, None, None, None, None, 2015, 2021, 2020]
    valid = apply(spark, lambda c: C.is_valid_claim(F.lit("p"), c), days)
    assert valid == [True, False, False, False, False, False, False, True]
    assert not any(apply(spark, lambda c: C.is_valid_claim(F.lit(None), c), days))


def test_validity_agrees_with_the_parser(spark):
    days = [f"{y}{m:02d}{d:02d}" for y in (1900, 2000, 2016, 2019) for m in range(0, 14) for d in range(0, 33)]
    days += ["+2016010", "-2016010", " 2016010", "2016010 ", "2016010.", "2016 101", "abcdefgh", "201601011"]
    parsed = apply(spark, C.parse_yyyymmdd, days)
    valid = apply(spark, lambda c: C.is_valid_claim(F.lit("p"), c, 1900, 2020), days)
    assert valid == [p is not None for p in parsed] and sum(valid) == 365 + 366 + 366 + 365


def test_year_window_ends_at_midnight(spark):
    times = ["2016-12-31 00:00:00", "2016-12-31 08:00:00", "2016-01-01 00:00:00"]
    keep = apply(spark, lambda c: C.in_age_and_year(F.lit(50), c.cast("timestamp_ntz"), 2016), times)
    assert keep == [True, False, True]


def test_codes(spark):
    codes = ["F11.20", " f1120 ", "YF1120", "4019", "", None, "Z00129"]
    assert apply(spark, C.normalize_icd, codes) == [
        "F1120", "F1120", "F1120", "", None, None, "Z00129"]
    assert apply(spark, lambda c: C.normalize_icd(c, True), codes)[3] is None
    assert apply(spark, C.normalize_cpt, ["99.21 3a"]) == ["99213A"]
    assert apply(spark, lambda c: C.matches_variant(c, "F11.20", "equals"), codes) == [
        True, True, False, False, False, None, False]


def test_code_prefix_uses_patterns(spark):
    got = apply(spark, lambda c: C.code_prefix(["f11.2", "%129"], c), ["F11.20", "Z00129", "F10", None])
    assert got == [True, True, False, False]


def test_any_code_in_ignores_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "z"), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(C.any_code_in(["z"], ["x", "y"])).collect()] == [
        False, True, False]


def test_excluded_codes(spark):
    got = apply(spark, lambda c: C.is_excluded_code(c, EXCLUDED_CODES), ["xF11z", "hcg1", "A10", None])
    assert got == [True, True, False, False]


def test_opioid_code_set():
    codes = OPIOID_CODES
    assert len(codes) == len(set(codes)) == 180
    assert {"F11.20", "F1120", "T40.0", "T4069", "Y129", "F1199"} <= set(codes)


def test_headers():
    assert len(PHARMACY_HEADER) == 51 and PHARMACY_HEADER[-1] == "Total RX Days Supply"
    assert len(MEDICAL_HEADER) == len(set(MEDICAL_HEADER)) == 113
    second = MEDICAL_REPAIR_HEADER.index("6th ICD Procedure Rollup")
    assert MEDICAL_REPAIR_HEADER[second - 1] == "6th ICD Procedure Desc"
    assert MEDICAL_REPAIR_HEADER[:second] + MEDICAL_REPAIR_HEADER[second + 1:] == MEDICAL_HEADER


def test_drug_names(spark):
    names = ["drug_A/B", "b+a", "x_hcl", "x_hclz", "{unnest: Foo Bar}", "", None]
    assert apply(spark, D.clean_drug_name, names) == [
        "A_B", "b_a", "x_hydrochloride", "x_hclz", "{unnest: Foo Bar}", "", None]
    assert apply(spark, D.clean_drug_name_simple, names) == [
        "drug_a_b", "b_a", "x_hydrochloride", "x_hclz", "foo_bar", "", None]
    assert apply(spark, D.sort_combination, ["b+a", "c"]) == ["a+b", "c"]
    assert apply(spark, D.device_to_marker, ["Insulin PUMP", "aspirin"]) == ["not_drug", "aspirin"]
    assert apply(spark, D.tokenize_drug, [" a, b;c "]) == [["drug_a", "drug_b", "drug_c"]]


def test_encodings(spark):
    one = apply(spark, lambda c: D.encode_drug(c, {"support": F.lit(0.1234)}), ["codeine"])[0]
    # letter C, 7 letters, co-dei-ne minus the final e, consonants c d n, vowels o e i e
    assert one == "333" + "07" + "02" + "03" + "04" + "00" + "01" + "00" + "01" + "0123" + "000" + "000"
    assert len(apply(spark, lambda c: D.encode_drug(c, {}, 21), ["codeine"])[0]) == 21
    fields = D.parse_encoding("v")
    df = spark.createDataFrame([(one,), ("12",)], "v string")
    got = df.select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert got[0]["support"] == 123 and got[0]["letter"] == 333 and got[1]["letter"] is None


def test_parse_rule(spark):
    parts = D.parse_rule("v")
    df = spark.createDataFrame([("0.5_0.25_2",), ("x",)], "v string").select(
        *[c.alias(n) for n, c in parts.items()])
    assert [tuple(r) for r in df.collect()] == [(0.5, 0.25, 2.0), (None, None, None)]


def test_names(spark):
    assert snake_case("2nd ICD  Diagnosis Code ") == "two_icd_diagnosis_code"
    assert snake_case("10th ICD Rollup") == "ten_icd_rollup"
    assert snake_case("3D Scan") == "_3d_scan"
    df = spark.createDataFrame([(1, 2)], ["A B", "1st X"])
    assert snake_case_columns(df).columns == ["a_b", "one_x"]
    assert df.select(select_or_null(df, "x", "1st X")).first()["x"] == 2
    out = null_filled_select(df, ["q", "A B"], {"q": F.lit("v")})
    assert tuple(out.first()) == ("v", 1)


def test_shifted_fields(spark):
    df = spark.createDataFrame(
        [(None, "54", "F", "DY"), (54.0, "54", "M", "DY"), (154.0, "F", "KG", "DY")],
        "age double, gndr_cod string, wt_cod string, age_cod string")
    got = [tuple(r) for r in repair_shifted_fields(df).select("age", "gndr_cod", "age_cod").collect()]
    assert got == [(54.0, "54", "DY"), (54.0, "M", "YR"), (154.0, "F", "DY")]


def test_band_names_the_age_once(spark):
    ages = [None, "-1", "0", "12", "13", " 25 ", "94", "95", "114", "115", "2147483647", "x", "7.5"]
    df = spark.createDataFrame([(a,) for a in ages], "age string").select("age", C.age_band(F.upper("age")).alias("b"))
    want = ["Other", "Other", "0-12", "0-12", "13-24", "25-44", "85-94", "95-114", "95-114", "Other", "Other", "Other"]
    assert [r["b"] for r in df.collect()][:12] == want
    assert df.select("b")._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_dates_of_the_calendar_and_few_mentions(spark):
    days = {"20200229": True, "20190229": False, "21000229": False, "20200431": False, "20201301": False, "20200100": False,
            "20200131": True, " 2020013": False, "+2020013": False, "2020-1-3": False, "202001311": False, "19951231": False, None: False}
    df = spark.createDataFrame([(d,) for d in days], "d string")
    kept = df.select("d", C.is_valid_claim(F.lit(1), F.lower("d"), 1996, 2100).alias("ok"))
    assert {r["d"]: r["ok"] for r in kept.collect()} == days
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 6
