"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import TABLE_DIR, compare, connect

FOLDER, LARGER = f"{TABLE_DIR}/sf0.001", f"{TABLE_DIR}/sf0.01"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    if verdict == "EMPTY":  # thresholds that the smallest tables don't reach: an empty match is none
        verdict = compare(spark, connect(LARGER), name, QUERIES[name], SQL.get(name), LARGER)
    assert verdict == "ok" or verdict.startswith("rows only"), verdict


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 1 and "control_case_ratio" in out.columns


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize(
    "name", ["event_fact", "case_control_cohort", "windowed_cohort", "trace_coverage",
             "mid_frequency_drugs", "imputed_pharmacy"]
)
def test_same_result_with_other_partitioning(spark, name):
    from oracle import spark_table

    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = spark_table(QUERIES[name](spark, FOLDER))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert spark_table(QUERIES[name](spark, FOLDER)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
