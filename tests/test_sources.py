import json

from careloom.sources import delimited as D
from careloom.sources import sinks
from careloom.sources import tables as B
from conftest import rows

HEADER = ["id", "drug name", "code", "a", "b"]


def repaired(spark, values, header=HEADER, tail=2):
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    return [tuple(r) for r in D.repair_ragged_rows(lines, header, tail).collect()]


def test_repair_exact_short_and_long(spark):
    got = repaired(spark, ["1|x|c|2|3", "1|x|c|2", "1", "1|x|y|z|c|2|3"])
    assert got == [
        ("1", "x", "c", "2", "3", "fixed"),
        ("1", "x", "c", "2", "", "padded"),
        ("1", "", "", "", "", "padded"),
        ("1", "x|y|z", "c", "2", "3", "spilled"),
    ]


def test_repair_without_a_name_column_spills_before_the_tail(spark):
    assert repaired(spark, ["1|x|y|2|3"], ["id", "q", "a", "b"]) == [("1", "x|y", "2", "3", "spilled")]


def test_repair_keeps_every_line(spark):
    lines = spark.createDataFrame([("a|" * i,) for i in range(12)], "value string")
    out = D.repair_counts(D.repair_ragged_rows(lines, HEADER, 2))
    assert sum(r["n"] for r in out.collect()) == 12


def test_split_good_bad_keeps_whole_lines(spark):
    long = "x" * 500
    lines = spark.createDataFrame([("a|b",), (long,), ("a|b|c",)], "value string")
    good, bad = D.split_good_bad(lines, 2)
    assert rows(good) == [("a|b",)] and (long,) in rows(bad) and bad.count() == 2


def test_cp1252_and_sniffing(spark, tmp_path):
    path = tmp_path / "claims.txt"
    path.write_bytes("\nid\tname\n1\tcaf\xe9 \x80\n2\t\n".encode("latin1"))
    assert D.sniff_separator(D.read_lines(spark, str(path))) == "\t"
    df = D.read_delimited_auto(spark, str(path))
    assert df.columns == ["id", "name"]
    assert rows(df) == [("1", "café €"), ("2", None)]


def test_mapping_files_override_in_order(spark, tmp_path):
    (tmp_path / "a_mappings.json").write_text(json.dumps({"Foo": "Bar", "x": "1"}))
    (tmp_path / "b_mappings.json").write_text(json.dumps({"foo": "BAZ"}))
    assert rows(B.load_mapping(spark, f"{tmp_path}/*.json")) == [("foo", "baz"), ("x", "1")]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "0-12", 2016), (2, "0-12", 2017), (3, "13-24", 2016)],
                               "v int, age_band string, event_year int")
    assert sinks.write_partitioned(df, root)
    assert not sinks.write_partitioned(df, root, if_exists="skip")
    sinks.write_partitioned(df.filter("v = 1").selectExpr("9 as v", "age_band", "event_year"), root)
    assert rows(B.read_partitions(spark, root).select("v")) == [(2,), (3,), (9,)]
    pruned = B.read_partitions(spark, root, ["0-12"], [2016])
    assert rows(pruned.select("v")) == [(9,)]
    assert "PartitionFilters" in pruned._jdf.queryExecution().toString()
    assert not B.exists(spark, str(tmp_path / "none"))


def test_merge_skips_part_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "main"))
    skip = "/main/"
    assert B.read_parquet_merge(spark, [str(tmp_path)], skip).count() == 0
    assert B.read_parquet_merge(spark, [str(tmp_path)]).count() == 3


def test_metrics_take_labels_from_paths(spark, tmp_path):
    folder = tmp_path / "cohort_name=a" / "age_band=0-12"
    folder.mkdir(parents=True)
    (folder / "m.json").write_text('{"n": 5}')
    out = B.consolidate_metrics(spark, [str(folder / "m.json")])
    assert rows(out.select("n", "cohort_name", "age_band", "event_year")) == [(5, "a", "0-12", None)]


def test_latest_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "v int, items array<string>")
    sinks.write_latest(df.select("v"), str(tmp_path / "p"), str(tmp_path / "c"))
    sinks.write_json_records(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["v"] == "1"
    assert spark.read.json(str(tmp_path / "j")).first()["items"] == ["a"]


def test_skip_is_per_partition(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "v int, age_band string, event_year int"
    sinks.write_partitioned(spark.createDataFrame([(1, "0-12", 2016)], schema), root)
    more = spark.createDataFrame([(5, "0-12", 2016), (2, "0-12", 2017)], schema)
    assert sinks.write_partitioned(more, root, if_exists="skip")
    assert rows(spark.read.parquet(root).select("v")) == [(1,), (2,)]


def test_skipped_files_give_no_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(2).selectExpr("id as other").write.parquet(str(tmp_path / "skipped"))
    (tmp_path / "x.part_1.parquet").write_text("broken")
    out = B.read_parquet_merge(spark, [str(tmp_path)], r"/skipped/|\.part_[^/]*\.parquet$")
    assert out.columns == ["id"] and out.count() == 3


def test_raw_files_lose_no_line(spark, tmp_path):
    head = "|".join(HEADER)
    (tmp_path / "one.txt").write_bytes(f"{head}\n1|x|c|2|3\n2|y|surplus|c|4|5\n".encode("latin1"))
    (tmp_path / "two.txt").write_bytes(f"{head}\n3|caf\xe9\n\n".encode("latin1"))
    table, rejects = D.read_repaired(spark, str(tmp_path / "*.txt"), HEADER, 2)
    assert rows(table) == [
        ("1", "x", "c", "2", "3", "fixed"), ("2", "y|surplus", "c", "4", "5", "spilled"),
        ("3", "café", "", "", "", "padded"),
    ]
    assert rejects.count() == 0
    _, rejects = D.read_repaired(spark, str(tmp_path / "one.txt"), HEADER[:2], 2)
    assert rows(rejects) == [("1|x|c|2|3",), ("2|y|surplus|c|4|5",)]


def test_cohort_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", 2016, "0-12")], "v int, cohort_name string, event_year int, age_band string")
    assert sinks.write_cohort(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "cohort_name=c" / "event_year=2016" / "age_band=0-12").is_dir()
