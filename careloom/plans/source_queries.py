"""Reading, repairing and writing, on text and files that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from careloom.plans.registry import query
from careloom.session import shared_folder
from careloom.sources import delimited as D
from careloom.sources import sinks
from careloom.sources import tables as B


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/careloom-{name}-{uuid.uuid4().hex}"


_HEADER = ["key", "part_name", "flag", "quantity", "price"]
_LINE = """case when l_returnflag = 'R' then concat_ws('|', l_orderkey, 'a|b', l_linestatus, {q}, {p})
  when l_returnflag = 'A' and l_linestatus = 'F' then concat_ws('|', l_orderkey, 'x', l_linestatus)
  else concat_ws('|', l_orderkey, 'plain', l_linestatus, {q}, {p}) end"""


def _lines(t):
    text = _LINE.format(q="cast(l_quantity as int)", p="l_linenumber")
    return t.lineitem.select(F.expr(text).alias("value"))


_LINES = "lines as (select " + _LINE.format(
    q="cast(l_quantity as integer)", p="l_linenumber") + " as value, string_split(value, '|') as f from lineitem)"


@query(f"""with {_LINES}, r as (select case when len(f) = 5 then 'fixed' when len(f) < 5 then 'padded'
    else 'spilled' end as repair_status, f[1] as key,
    case when len(f) = 6 then f[2] || '|' || f[3] else f[2] end as part_name,
    case when len(f) = 6 then f[4] else f[3] end as flag,
    case when len(f) = 6 then f[5] else coalesce(f[4], '') end as quantity,
    case when len(f) = 6 then f[6] else coalesce(f[5], '') end as price from lines)
select key, part_name, flag, quantity, price, repair_status, count(*) as n from r group by all""")
def repaired_lines(t):
    fixed = D.repair_ragged_rows(_lines(t), _HEADER, 2)
    return fixed.groupBy(*_HEADER, "repair_status").agg(F.count("*").alias("n"))


@query(f"""with {_LINES} select case when len(f) = 5 then 'fixed' when len(f) < 5 then 'padded'
  else 'spilled' end as repair_status, count(*) as n from lines group by 1""")
def repair_counts(t):
    return D.repair_counts(D.repair_ragged_rows(_lines(t), _HEADER, 2))


@query(f"""with {_LINES} select len(f) = 5 as good, value, count(*) as n from lines group by 1, 2""")
def split_lines(t):
    good, bad = D.split_good_bad(_lines(t), 5)
    parts = good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return parts.groupBy("good", "value").agg(F.count("*").alias("n"))


@query("""select cast(c_custkey as varchar) as "Person Key", c_name || ' é' as "Name",
  c_mktsegment as "Payer Type" from customer""")
def delimited_round_trip(t):
    """Customers written as CP1252 pipe text and read back with a sniffed separator."""
    path = _folder(t, "text")
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("Person Key"),
        F.concat("c_name", F.lit(" é")).alias("Name"), F.col("c_mktsegment").alias("Payer Type"),
    )
    D.write_delimited(rows, path)
    columns = D.read_delimited_auto(t.spark, path).columns
    return D.read_delimited(t.spark, path, columns)


@query("""select o_orderkey, o_orderstatus as status, cast(year(o_orderdate) as integer) as event_year
from orders where year(o_orderdate) in (1996, 1998) and o_orderstatus in ('F', 'O')""")
def partitioned_round_trip(t):
    """Orders written by status and year, read back with partition pruning."""
    root = _folder(t, "parts")
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("event_year")
    )
    sinks.write_partitioned(rows, root, ["status", "event_year"], sort=["o_orderkey"])
    sinks.write_partitioned(rows.limit(0), root, ["status", "event_year"], if_exists="skip")
    return B.read_partitions(t.spark, root, ["F", "O"], [1996, 1998], band="status")


@query("""select o_orderkey, case when o_orderstatus = 'F' then o_totalprice end as price,
  case when o_orderstatus <> 'F' then o_orderpriority end as priority from orders where o_orderstatus <> 'P'""")
def merged_files(t):
    """Files of different columns united by name; leftover part files are skipped."""
    root = _folder(t, "merge")
    t.orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", F.col("o_totalprice").alias("price")).write.parquet(f"{root}/a")
    t.orders.filter("o_orderstatus = 'O'").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority")).write.parquet(f"{root}/b")
    t.orders.filter("o_orderstatus = 'P'").select("o_orderkey").write.parquet(f"{root}/skipped")
    return B.read_parquet_merge(t.spark, [root], "/skipped/[^/]*[.]parquet$")


@query("""select o_orderstatus as cohort_name, cast(year(o_orderdate) as varchar) as event_year,
  o_orderpriority as age_band, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all""")
def consolidated_metrics(t):
    """Metric JSON written per partition and gathered with the labels of the paths."""
    root = _folder(t, "metrics")
    rows = t.orders.groupBy(
        F.col("o_orderstatus").alias("cohort_name"), F.year("o_orderdate").alias("event_year"),
        F.col("o_orderpriority").alias("age_band"),
    ).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows.write.partitionBy("cohort_name", "event_year", "age_band").json(root)
    flat = B.consolidate_metrics(
        t.spark.newSession(), f"{root}/*/*/*", ["cohort_name", "event_year", "age_band"]
    )
    return flat


@query("""select lower(p_brand) as key, lower(max(p_name)) as value from part group by 1""")
def loaded_mapping(t):
    """Mapping dictionaries, one JSON object per file, read back as (key, value)."""
    root = _folder(t, "maps")
    pairs = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.upper(F.max("p_name")).alias("v"))
    # One dictionary per first letters of the key; the vocabulary of a dictionary is small.
    objects = pairs.groupBy(F.length("k").alias("letter")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")
    )
    objects.repartition("letter").write.partitionBy("letter").text(root)
    return B.load_mapping(t.spark, f"{root}/*/*.txt")


@query("""select c_custkey, c_mktsegment as segment, round(c_acctbal, 2) as balance from customer""")
def latest_copy(t):
    """The latest copy of a table and its CSV twin; the second write replaces the first."""
    root = _folder(t, "latest")
    rows = t.customer.select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance")
    )
    sinks.write_latest(rows.limit(1), f"{root}/p", f"{root}/c")
    sinks.write_latest(rows, f"{root}/p", f"{root}/c")
    twin = t.spark.read.csv(f"{root}/c", header=True, schema=rows.schema)
    return t.spark.read.parquet(f"{root}/p").intersectAll(twin)


@query("""select o_orderkey, o_orderstatus as cohort_name, cast(year(o_orderdate) as integer) as event_year,
  o_orderpriority as age_band from orders""")
def written_cohort(t):
    """A cohort table by cohort, year and band; a second write skips the partitions that are there."""
    root = _folder(t, "cohort")
    rows = t.orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("cohort_name"),
        F.year("o_orderdate").alias("event_year"), F.col("o_orderpriority").alias("age_band"),
    )
    sinks.write_cohort(rows.filter("cohort_name <> 'P'"), root)
    sinks.write_cohort(rows, root, if_exists="skip")
    return t.spark.read.parquet(root)


@query("""select p_brand as brand, array_to_string(list_sort(list(distinct p_type)), '|') as types,
  count(*) as n from part group by 1""")
def json_records(t):
    """Records with lists, written as JSON lines and read back."""
    path = _folder(t, "json")
    rows = t.part.groupBy(F.col("p_brand").alias("brand")).agg(
        F.sort_array(F.collect_set("p_type")).alias("types"), F.count("*").alias("n")
    )
    sinks.write_json_records(rows, path)
    read = t.spark.read.schema(rows.schema).json(path)
    return read.withColumn("types", F.array_join("types", "|"))


@query(f"""with {_LINES}, n as (select count(*) as n_lines from lines)
select case when len(f) = 5 then 'fixed' when len(f) < 5 then 'padded' else 'spilled' end as repair_status,
  f[1] as key, case when len(f) = 6 then f[2] || '|' || f[3] else f[2] end || ' é' as part_name,
  case when len(f) = 6 then f[4] else f[3] end as flag,
  cast(case when len(f) = 6 then f[5] else f[4] end as integer) as quantity, count(*) as n,
  0 as rejects from lines group by all""")
def repaired_files(t):
    """CP1252 files with a header each: read, split, repaired and typed; rejects are counted."""
    path = _folder(t, "raw")
    body = _lines(t).select(F.regexp_replace("value", r"^([^|]*[|](?:a[|]b|x|plain))", "$1 é").alias("value"))
    D.write_delimited(body.withColumnRenamed("value", "|".join(_HEADER)).repartition(3), path, "\u0001")
    table, rejects = D.read_repaired(t.spark, path, _HEADER, 2)
    typed = table.withColumn("quantity", F.expr("try_cast(quantity as int)"))
    counted = typed.groupBy("repair_status", "key", "part_name", "flag", "quantity").agg(F.count("*").alias("n"))
    return counted.withColumn("rejects", F.lit(rejects.count()))
