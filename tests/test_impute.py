import datetime

from pyspark.sql import functions as F

from careloom.operators import impute as I
from careloom.operators import mapping as M
from conftest import rows

SCHEMA = ("person string, event_year int, age int, gender string, race string, zip string, "
          "county string, payer string")


def claims(spark, data):
    full = [(p, y, a, g, None, None, None, None) for p, y, a, g in data]
    return spark.createDataFrame(full, SCHEMA)


def imputed(spark, a, b, years=5):
    out, _ = I.impute_profiles(claims(spark, a), claims(spark, b), "med", "ph", years)
    return {(r["person"], r["event_year"]): (r["age_imputed"], r["age_source"], r["gender_imputed"],
                                             r["gender_source"]) for r in out.collect()}


def test_gap_limit(spark):
    got = imputed(spark, [("p", 2010, None, None), ("q", 2010, None, None)],
                  [("p", 2015, 40, "F"), ("q", 2016, 40, "F")])
    assert got[("p", 2010)] == (40, "imputed_from_ph", "F", "imputed_from_ph")
    assert got[("q", 2010)] == (None, "original", None, "original")


def test_nearest_year_then_claim_count_then_earlier_year(spark):
    b = [("p", 2011, 11, "A"), ("p", 2013, 13, "B"), ("p", 2013, 13, "B")]
    assert imputed(spark, [("p", 2012, None, None)], b)[("p", 2012)][0] == 13
    tie = [("p", 2011, 11, "A"), ("p", 2013, 13, "B")]
    assert imputed(spark, [("p", 2012, None, None)], tie)[("p", 2012)][0] == 11
    near = [("p", 2012, 12, "C"), ("p", 2013, 13, "B"), ("p", 2013, 13, "B")]
    assert imputed(spark, [("p", 2012, None, None)], near)[("p", 2012)][0] == 12


def test_implausible_age_is_replaced_even_by_nothing(spark):
    got = imputed(spark, [("p", 2016, 115, "F"), ("q", 2016, 115, "F")], [("p", 2016, 50, "M")])
    assert got[("p", 2016)] == (50, "imputed_from_ph", "F", "original")
    assert got[("q", 2016)] == (None, "original", "F", "original")


def test_own_values_win_and_other_source_mirrors(spark):
    a, b = claims(spark, [("p", 2016, 30, "F")]), claims(spark, [("p", 2017, None, None)])
    left, right = I.impute_profiles(a, b, "med", "ph")
    assert left.first()["age_imputed"] == 30
    assert (right.first()["age_imputed"], right.first()["age_source"]) == (30, "imputed_from_med")


def test_lookup_lists_only_years_with_gaps(spark):
    a = claims(spark, [("p", 2016, 30, "F")])
    whole = spark.createDataFrame([("q", 2016, 1, "g", "r", "z", "c", "p")], SCHEMA)
    out = I.demographics_lookup(a, whole, "med", "ph")
    assert [(r["person"], r["event_year"]) for r in out.collect()] == [("p", 2016)]


def test_normalize_claims_drops_bad_rows(spark):
    df = spark.createDataFrame(
        [("p", "20160101", " 9 ", " F "), (None, "20160101", "9", "F"), ("p", "20161301", "9", "F"),
         ("p", "20210101", "9", "F")], "key string, day string, age string, gender string")
    demo = {d: "gender" for d in I.DEMOGRAPHICS} | {"age": "age"}
    out = I.normalize_claims(df, "key", "day", demo, {"drug": ["Drug Name"]})
    got = out.collect()
    assert len(got) == 1 and got[0]["age"] == 9 and got[0]["gender"] == "F" and got[0]["drug"] is None


def test_clean_medical_levels(spark):
    base = claims(spark, [("p", 2016, 12, "F")])
    a, _ = I.impute_demographics(base, base, "med", "ph")
    out = I.clean_medical(a.withColumn("date_text", F.lit("20160229"))).first()
    assert out["age_band"] == "0-12" and out["event_date"] == datetime.date(2016, 2, 29)
    assert out["total_missing_fields"] == 4 and out["data_quality_level"] == "partial"


def test_append_and_backfill(spark):
    main = spark.createDataFrame([(1, "a")], "id int, v string")
    part = spark.createDataFrame([(1, "z"), (2, None)], "id int, v string")
    assert rows(I.append_new(main, part, "id")) == [(1, "a"), (2, None)]
    lookup = spark.createDataFrame([(2, "L"), (1, "K")], "id int, w string")
    assert rows(I.backfill(part, lookup, ["id"], {"v": "w"})) == [(1, "z"), (2, "L")]


def test_code_and_drug_maps(spark):
    m = spark.createDataFrame([("F1120", "F112"), ("asa", "aspirin")], "key string, value string")
    t = spark.createDataFrame([("4019", "I10")], "key string, value string")
    df = spark.createDataFrame([("F11.20", "4019", " ASA ", "9 9"), ("", None, " ", None), ("Q99.1", "77", "x", "a.b")],
                               "d1 string, d2 string, drug string, px string")
    out = M.apply_code_maps(M.apply_drug_map(df, m, "drug"), ["d1", "d2"], m, t, ["px"])
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([("F112", "I10", "aspirin", "99"), (None, None, None, None),
                          ("Q991", None, "x", "AB")], key=repr)
    kept = M.apply_code_maps(df, ["d2"], m, keep_unmatched=True)
    assert "77" in [r["d2"] for r in kept.collect()]


def test_suggested_mappings(spark):
    freq = spark.createDataFrame([("F11.20", 3), ("F1120", 9), (" f1120", 1)], "c string, n int")
    assert rows(M.suggest_mapping(freq, "c", "n").select("variant", "canonical")) == [
        (" f1120", "F1120"), ("F11.20", "F1120")]
    cpt = spark.createDataFrame([("99213", 1), ("99213.", 9), ("a1", 2), ("A1", 5)], "c string, n int")
    assert rows(M.suggest_mapping(cpt, "c", "n", "cpt").select("variant", "canonical")) == [
        ("99213.", "99213"), ("a1", "A1")]


def test_thirteen_slots_take_two_exchanges(spark, tmp_path):
    """However many slots, claims meet the dictionary once and are regrouped once."""
    slots = [f"d{i}" for i in range(13)]
    data = [(i, *[None if (i + j) % 3 else f"F11.{(i * j) % 9}" for j in range(13)], i % 2) for i in range(40)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{s} string" for s in slots) + ", other int")
    icd = spark.createDataFrame([("F113", "X1"), ("F115", "X2")], "key string, value string")
    bound = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "-1")
    try:
        out = M.apply_code_maps(df, slots, icd)
        got = {r["id"]: r for r in out.collect()}
        final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set(bound, before)
    exchanges = [line for line in final.splitlines() if "Exchange" in line]
    regroups = [line for line in exchanges if "hashpartitioning(__id" in line]
    meets = [line for line in exchanges if "hashpartitioning(cpt" in line]
    assert len(regroups) == 1 and len(meets) <= 3  # claims and dictionary meet, after the dictionary's distinct
    codes = spark.createDataFrame([(c,) for c in {v for r in data for v in r[1:14] if v}], "c string")
    want = {r["c"]: r["n"] for r in codes.select("c", M.normalize_icd("c").alias("n")).collect()}
    mapped = {"F113": "X1", "F115": "X2"}
    for row in data:
        r = got[row[0]]
        assert [r[s] for s in slots] == [v and mapped.get(want[v], want[v]) for v in row[1:14]]
        assert r["other"] == row[14]
