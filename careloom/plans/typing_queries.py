"""Typing, predicate and clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.constants import DEVICE_WORDS
from careloom.functions import columns as C
from careloom.functions import drugs as D
from careloom.operators import projection as P
from careloom.plans import standin as S
from careloom.plans.registry import query


@query("""
select case when try_cast(a as integer) between 0 and 12 then '0-12'
            when try_cast(a as integer) between 13 and 24 then '13-24'
            when try_cast(a as integer) between 25 and 44 then '25-44'
            when try_cast(a as integer) between 45 and 54 then '45-54'
            when try_cast(a as integer) between 55 and 64 then '55-64'
            when try_cast(a as integer) between 65 and 74 then '65-74'
            when try_cast(a as integer) between 75 and 84 then '75-84'
            when try_cast(a as integer) between 85 and 94 then '85-94'
            when try_cast(a as integer) between 95 and 114 then '95-114' else 'Other' end as band,
       count(*) as n
from (select cast(cast(floor(l_quantity * 3 - 5) as integer) as varchar) as a from lineitem)
group by 1""")
def age_band_counts(t):
    age = F.floor(F.col("l_quantity") * 3 - 5).cast("int").cast("string")
    return t.lineitem.groupBy(C.age_band(age).alias("band")).agg(F.count("*").alias("n"))


@query("""
select event_id, case when regexp_matches(d, '^[0-9]{8}$')
                      then cast(try_strptime(d, '%Y%m%d') as date) end as parsed,
       cast(case when regexp_matches(d, '^[0-9]{8}$')
                 then year(try_strptime(d, '%Y%m%d')) end as integer) as event_year
from (select event_id, case when event_type = 'error'
        then lpad(cast(cast(floor(value * 100000) as bigint) as varchar), 8, '0')
        when event_type = 'click' then strftime(ts, '%Y-%m-%d')
        else strftime(ts, '%Y%m%d') end as d from events)""")
def parsed_dates(t):
    digits = F.lpad(F.floor(F.col("value") * 100000).cast("bigint").cast("string"), 8, "0")
    text = (
        F.when(F.col("event_type") == "error", digits)
        .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyyMMdd"))
    )
    return t.events.select(
        "event_id", C.parse_yyyymmdd(text).alias("parsed"), C.event_year(text).alias("event_year")
    )


@query("""
select event_id, case when trim(x) = '' or upper(trim(x)) = 'NULL' then null
                      else try_cast(trim(x) as integer) end as k,
       nullif(trim(y), '') as kind
from (select event_id, case when event_type = 'error' then ' null '
             when event_type = 'view' then '  '
             when event_type = 'click' then 'k' || event_id
             else ' ' || cast(cast(floor(value) as integer) as varchar) || ' ' end as x,
             case when event_type = 'view' then '  ' else event_type || ' ' end as y
      from events)""")
def cleaned_integers(t):
    kind = F.col("event_type")
    x = (
        F.when(kind == "error", " null ")
        .when(kind == "view", "  ")
        .when(kind == "click", F.concat(F.lit("k"), F.col("event_id")))
        .otherwise(F.concat(F.lit(" "), F.floor("value").cast("int").cast("string"), F.lit(" ")))
    )
    y = F.when(kind == "view", "  ").otherwise(F.concat(kind, F.lit(" ")))
    return t.events.select("event_id", C.clean_int(x).alias("k"), C.blank_to_null(y).alias("kind"))


@query("""
select cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
       cast(quarter(l_shipdate) as integer) as quarter,
       cast(weekofyear(l_shipdate) as integer) as week, cast(day(l_shipdate) as integer) as day,
       case when month(l_shipdate) in (12, 1, 2) then 'winter'
            when month(l_shipdate) in (3, 4, 5) then 'spring'
            when month(l_shipdate) in (6, 7, 8) then 'summer' else 'autumn' end as season,
       count(*) as n
from lineitem group by all""")
def calendar_parts(t):
    parts = {**C.time_parts("l_shipdate"), "season": C.season("l_shipdate")}
    return t.lineitem.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(
        F.count("*").alias("n")
    )


@query("""
select o_custkey as person, cast(min(o_orderdate) as date) as first_event,
       cast(max(o_orderdate) as date) as last_event,
       cast(date_diff('day', min(o_orderdate), max(o_orderdate)) as integer) as span_days,
       count(*) as n
from orders group by 1""")
def event_span(t):
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    return t.orders.groupBy(F.col("o_custkey").alias("person")).agg(
        first.cast("date").alias("first_event"),
        last.cast("date").alias("last_event"),
        F.datediff(last, first).alias("span_days"),
        F.count("*").alias("n"),
    )


@query("""
select s_suppkey as supp_key, s_nationkey as one_nation_code, s_name as _2_name,
       cast(null as varchar) as missing
from supplier""")
def renamed_supplier(t):
    raw = t.supplier.select(
        F.col("s_suppkey").alias("Supp  Key"),
        F.col("s_nationkey").alias("1st Nation Code"),
        F.col("s_name").alias("2 Name "),
    )
    named = P.snake_case_columns(raw)
    return P.null_filled_select(named, ["supp_key", "one_nation_code", "_2_name", "missing"])


@query("""
select level, missing, count(*) as n from (
  select (case when a is null then 1 else 0 end + case when b is null then 1 else 0 end
        + case when c is null then 1 else 0 end + case when d is null then 1 else 0 end) as missing,
         case when a is not null and b is not null then 'complete' else 'partial' end as level
  from (select nullif(l_returnflag, 'R') as a, nullif(l_linestatus, 'F') as b,
               case when l_quantity > 10 then l_quantity end as c,
               case when l_discount > 0.02 then l_discount end as d from lineitem))
group by all""")
def row_quality(t):
    rows = t.lineitem.select(
        F.nullif("l_returnflag", F.lit("R")).alias("a"),
        F.nullif("l_linestatus", F.lit("F")).alias("b"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("c"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("d"),
    )
    labelled = P.quality_level(rows, ["a", "b", "c", "d"], ["a", "b"])
    return labelled.groupBy(
        F.col("data_quality_level").alias("level"), F.col("total_missing_fields").alias("missing")
    ).agg(F.count("*").alias("n"))


@query(f"""
with {S.CLAIMS} select day, count(*) as n from claims_a
where key is not null and regexp_matches(day, '^[0-9]{{8}}$')
  and try_strptime(day, '%Y%m%d') is not null
  and cast(substr(day, 1, 4) as integer) between 1996 and 2000
group by 1""")
def valid_claim_days(t):
    rows = S.claims_a(t).filter(C.is_valid_claim("key", "day", 1996, 2000))
    return rows.groupBy("day").agg(F.count("*").alias("n"))


@query("""
select p_size as age, count(*) as n
from lineitem join part on l_partkey = p_partkey
where p_size between 10 and 40 and l_shipdate between timestamp '1998-01-01 00:00:00'
  and timestamp '1998-12-31 00:00:00' and year(l_shipdate) > 1900 and year(l_shipdate) < 2100
group by 1""")
def in_scope_claims(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kept = rows.filter(
        C.in_age_and_year("p_size", "l_shipdate", 1998, 10, 40)
        & C.is_plausible_date("l_shipdate")
    )
    return kept.groupBy(F.col("p_size").alias("age")).agg(F.count("*").alias("n"))


@query(f"""
with {S.MEDICAL}
select person, claim_id, line, part from medical
where code_1 in ('Brand#3', 'Brand#7') or code_2 in ('Brand#3', 'PROMO')
   or code_3 in ('Brand#7')""")
def coded_claims(t):
    wanted = ["Brand#3", "Brand#7"]
    hit = C.any_code_in(wanted, ["code_1"]) | C.any_code_in(["Brand#3", "PROMO"], ["code_2"])
    return S.medical(t).filter(hit | C.any_code_in(["Brand#7"], ["code_3"])).select(
        "person", "claim_id", "line", "part"
    )


@query("""
select p_partkey, p_name,
  coalesce(replace(replace(upper(p_name), '.', ''), ' ', '') like 'OLD%', false)
  or coalesce(replace(replace(upper(p_name), '.', ''), ' ', '') like '%RING', false) as prefixed,
  contains(lower(p_name), 'rod') or contains(lower(p_name), 'hot') as excluded
from part""")
def code_prefix_flags(t):
    return t.part.select(
        "p_partkey", "p_name",
        C.code_prefix(["o.ld", "%ring"], "p_name").alias("prefixed"),
        C.is_excluded_code("p_name", ["Rod", "HOT"]).alias("excluded"),
    )


@query("""
select p_partkey,
  case when trim(raw) = '' then null else replace(regexp_extract(upper(raw),
    '([A-Z][0-9]{2}(\\.?[A-Z0-9]{1,4})?)', 1), '.', '') end as icd,
  replace(replace(upper(raw), '.', ''), ' ', '') as cpt,
  regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') as flat,
  contains(regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g'), 'F1') as variant
from (select p_partkey, case when p_type = 'LARGE' then ' '
        when p_type = 'SMALL' then cast(p_partkey as varchar)
        else ' y' || lower(substr(p_brand, 1, 1)) || 'f' || cast(10 + p_size as varchar) || '.'
             || cast(p_size as varchar) || ' ' end as raw from part)""")
def normalized_codes(t):
    raw = (
        F.when(F.col("p_type") == "LARGE", " ")
        .when(F.col("p_type") == "SMALL", F.col("p_partkey").cast("string"))
        .otherwise(
            F.concat(
                F.lit(" y"), F.lower(F.substring("p_brand", 1, 1)), F.lit("f"),
                (F.col("p_size") + 10).cast("string"), F.lit("."),
                F.col("p_size").cast("string"), F.lit(" "),
            )
        )
    )
    rows = t.part.select("p_partkey", raw.alias("raw"))
    return rows.select(
        "p_partkey",
        C.normalize_icd("raw").alias("icd"),
        C.normalize_cpt("raw").alias("cpt"),
        C.flatten_code("raw").alias("flat"),
        C.matches_variant("raw", "F1", "contains").alias("variant"),
    )


_RAW_DRUG = """select p_partkey, case when p_type = 'PROMO' then 'drug_' || p_name || '_hcl'
    when p_type = 'LARGE' then '{unnest: ' || p_name || '}/b+a'
    when p_type = 'SMALL' then p_name || '_HCL extra' else p_name || '_hclz/' end as raw
  from part"""


def _raw_drugs(t):
    name = F.col("p_name")
    raw = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("drug_"), name, F.lit("_hcl")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("{unnest: "), name, F.lit("}/b+a")))
        .when(F.col("p_type") == "SMALL", F.concat(name, F.lit("_HCL extra")))
        .otherwise(F.concat(name, F.lit("_hclz/")))
    )
    return t.part.select("p_partkey", raw.alias("raw"))


@query(f"""
select p_partkey,
  trim(regexp_replace(replace(replace(regexp_replace(raw, '^drug_', '', 'i'), '+', '_'), '/', '_'),
    '_hcl([^a-zA-Z]|$)', '_hydrochloride\\1', 'gi')) as cleaned,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(
    lower(regexp_replace(raw, '\\{{[^}}]*:\\s*([^}}]+)\\}}', '\\1', 'g')), '+', '_'), '/', '_'),
    '[^a-z0-9\\s_]', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'),
    '_hcl([^a-zA-Z]|$)', '_hydrochloride\\1', 'g') as simple,
  array_to_string(list_sort(string_split(raw, '+')), '+') as sorted_parts,
  array_to_string(list_sort(string_split(replace(replace(regexp_replace(lower(raw), '/$', ''),
    ' ', '_'), '/', '+'), '+')), '+') as standardized
from ({_RAW_DRUG})""")
def cleaned_drug_names(t):
    return _raw_drugs(t).select(
        "p_partkey",
        D.clean_drug_name("raw").alias("cleaned"),
        D.clean_drug_name_simple("raw").alias("simple"),
        D.sort_combination("raw").alias("sorted_parts"),
        D.standardize_report_drug("raw").alias("standardized"),
    )


@query(f"""
select p_partkey, case when regexp_matches(lower(raw), '{"|".join(DEVICE_WORDS)}')
    then 'not_drug' else raw end as marked,
  array_to_string(list_sort(string_split(replace(replace(lower(trim(regexp_replace(raw,
    '[_"''():;,.!?\\-]', ' ', 'g'))), ' ', '_'), '/', '+'), '+')), '+') as report_name,
  array_to_string(list_transform(list_filter(regexp_split_to_array(trim(raw), '[ ,;]+'),
    lambda x: x <> ''), lambda x: 'drug_' || x), ' ') as tokens,
  array_to_string(list_filter(list_transform(regexp_split_to_array(lower(raw), '\\s+'),
    lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> ''), ' ') as words
from (select p_partkey, case when p_type = 'PROMO' then p_name || ' test_strip'
        when p_type = 'LARGE' then 'Pump ' || p_name
        when p_type = 'SMALL' then p_name || '; b,a' else p_name || '/a (b)' end as raw
      from part)""")
def drug_tokens(t):
    name = F.col("p_name")
    raw = (
        F.when(F.col("p_type") == "PROMO", F.concat(name, F.lit(" test_strip")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("Pump "), name))
        .when(F.col("p_type") == "SMALL", F.concat(name, F.lit("; b,a")))
        .otherwise(F.concat(name, F.lit("/a (b)")))
    )
    return t.part.select(
        "p_partkey",
        D.device_to_marker(raw).alias("marked"),
        D.normalize_report_drug(raw).alias("report_name"),
        F.array_join(D.tokenize_drug(raw), " ").alias("tokens"),
        F.array_join(D.name_words(raw), " ").alias("words"),
    )


_CONS = "[b-df-hj-np-tv-z]"


@query(f"""
select name, cast(length(name) as integer) as length,
  cast(case when syl = 0 then 1 else syl end as integer) as syllables,
  cast(len(regexp_extract_all(name, '{_CONS}')) as integer) as consonants,
  cast(len(regexp_extract_all(name, '[aeiou]')) as integer) as vowels,
  cast(len(regexp_extract_all(name, '[-_]')) as integer) as separators,
  cast(len(list_filter(['ine','ol','ate','ide','in','an','ic','al','um','on'],
    lambda s: suffix(name, s))) as integer) as suffixes,
  cast(len(regexp_extract_all(name, '{_CONS}{{2,}}')) as integer) as clusters,
  cast(len(list_filter(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '),
    lambda ch: length(name) - length(replace(name, ch, '')) > 1)) as integer) as repeats
from (select name, len(regexp_extract_all(name, '[aeiouy]+'))
             - case when suffix(name, 'e') then 1 else 0 end as syl
      from (select distinct replace(p_name, ' ', '_') as name from part))""")
def drug_name_features(t):
    names = t.part.select(F.translate("p_name", " ", "_").alias("name")).distinct()
    return names.select("name", *[c.alias(n) for n, c in D.drug_text_features("name").items()])


_ENC = f"""
select name, support, cast(letter as varchar) || lpad(cast(length(name) as varchar), 2, '0')
  || lpad(cast(case when syl = 0 then 1 else syl end as varchar), 2, '0')
  || lpad(cast(len(regexp_extract_all(name, '{_CONS}')) as varchar), 2, '0')
  || lpad(cast(len(regexp_extract_all(name, '[aeiou]')) as varchar), 2, '0')
  || lpad(cast(len(regexp_extract_all(name, '[-_]')) as varchar), 2, '0')
  || lpad(cast(len(list_filter(['ine','ol','ate','ide','in','an','ic','al','um','on'],
       lambda s: suffix(name, s))) as varchar), 2, '0')
  || lpad(cast(len(regexp_extract_all(name, '{_CONS}{{2,}}')) as varchar), 2, '0')
  || lpad(cast(len(list_filter(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z',
       ' '), lambda ch: length(name) - length(replace(name, ch, '')) > 1)) as varchar), 2, '0')
  || lpad(cast(cast(floor(support * 1000) as integer) as varchar), 4, '0') || '000' || '000'
  as encoding
from (select name, support, len(regexp_extract_all(name, '[aeiouy]+'))
        - case when suffix(name, 'e') then 1 else 0 end as syl,
        case substr(name, 1, 1) when 'b' then 222 when 'c' then 333 when 'h' then 888
          when 'l' then 303 when 'n' then 505 when 'o' then 606 when 'r' then 909
          when 's' then 110 end as letter
      from (select replace(p_name, ' ', '_') as name,
              count(*) / cast((select count(*) from part) as double) as support
            from part group by 1))"""


def _encoded(t):
    total = t.part.agg(F.count("*").alias("n")).scalar()
    names = t.part.groupBy(F.translate("p_name", " ", "_").alias("name")).agg(
        (F.count("*") / total).alias("support")
    )
    return names.withColumn("encoding", D.encode_drug("name", {"support": "support"}))


@query(f"select name, encoding from ({_ENC})")
def drug_encodings(t):
    return _encoded(t).select("name", "encoding")


@query(f"""
select cast(substr(encoding, 1, 3) as integer) as letter,
  sum(cast(substr(encoding, 4, 2) as integer)) as length,
  sum(cast(substr(encoding, 6, 2) as integer)) as syllables,
  sum(cast(substr(encoding, 20, 4) as integer)) as support
from ({_ENC}) group by 1""")
def pattern_encoding_sums(t):
    fields = D.parse_encoding("encoding")
    rows = _encoded(t).select(*[c.alias(n) for n, c in fields.items()])
    return rows.groupBy("letter").agg(
        *[F.sum(n).alias(n) for n in ("length", "syllables", "support")]
    )


@query(f"""
select substr(encoding, 1, 19) as shape, count(*) as drugs,
  array_to_string(list_sort(list(name)), '|') as names
from ({_ENC}) group by 1 having count(*) > 1""")
def encoding_collisions(t):
    from careloom.operators.mining import encoding_collisions as collide

    shapes = _encoded(t).withColumn("shape", F.substring("encoding", 1, 19))
    return collide(shapes, "name", "shape").select(
        "shape", "drugs", C.pipe_join("names").alias("names")
    )


@query("""
select l_returnflag, l_linestatus, support, confidence, lift,
  support >= 0.2 and confidence >= 0.3 and lift >= 0.9 as valid
from (select l_returnflag, l_linestatus,
        round(count(*) / 100000.0, 3) as support,
        round(avg(l_discount) * 10, 3) as confidence, round(avg(l_tax) * 25, 3) as lift
      from lineitem group by all)""")
def parsed_rules(t):
    rows = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.concat_ws(
            "_",
            F.round(F.count("*") / 100000.0, 3),
            F.round(F.avg("l_discount") * 10, 3),
            F.round(F.avg("l_tax") * 25, 3),
        ).alias("rule")
    )
    parsed = rows.select(
        "l_returnflag", "l_linestatus", *[c.alias(n) for n, c in D.parse_rule("rule").items()]
    )
    return parsed.withColumn(
        "valid", D.is_valid_rule("support", "confidence", "lift", 0.2, 0.3, 0.9)
    )


@query("""
select doc_id, length(text) as chars, array_to_string(list_sort(list_distinct(list_filter(
  list_transform(regexp_split_to_array(lower(text), '\\s+'),
    lambda w: case regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g') when 'the' then 'R1'
      when 'la' then 'R2' when 'that' then 'R3' end), lambda c: c is not null))), '_') as codes
from documents""")
def document_rule_codes(t):
    rules = {"the": "R1", "la": "R2", "that": "R3"}
    words = F.array_distinct(D.name_words("text"))
    return t.documents.select(
        "doc_id", F.length("text").cast("bigint").alias("chars"),
        D.rule_code(words, rules).alias("codes"),
    )
