"""Itemset and rule queries: a basket is an order, an item a part brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.functions import drugs as D
from careloom.operators import mining as N
from careloom.plans import claims_queries as Q
from careloom.plans.registry import query

_TX = """lines as (select l_orderkey as key, p_brand as item from lineitem
    join part on l_partkey = p_partkey),
  sized as (select key, count(*) as size, count(distinct item) as k from lines group by 1),
  base as (select distinct key, item from lines)"""


def _lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("key"), F.col("p_brand").alias("item")
    )


@query(f"""with {_TX} select key, array_to_string(list_sort(list(item)), '|') as items,
  any_value(size) as size from base join sized using (key) group by 1""")
def transactions(t):
    tx = N.transactions(_lines(t), "key")
    return tx.select("key", F.array_join("items", "|").alias("items"), "size")


_BINS = f"""{_TX}, cuts as (select quantile_cont(size, 0.25) as a, quantile_cont(size, 0.5) as b,
    quantile_cont(size, 0.95) as c from sized),
  binned as (select key, size, case when size <= a then 'low' when size <= b then 'medium'
    when size <= c then 'high' else 'extreme' end as density from sized, cuts)"""


@query(f"with {_BINS} select density, size, count(*) as n from binned group by all")
def transaction_density(t):
    binned = N.transaction_density(N.transactions(_lines(t), "key"))
    return binned.groupBy("density", "size").agg(F.count("*").alias("n"))


def _mined(floor: str, by: str = "1") -> str:
    """CTEs tid, n and frequent: itemsets of any size grown item by item over basket lists."""
    return f"""tid as (select {by} as g, item, list(key) as tids from based group by 1, 2),
  n as (select {by} as g, count(distinct key) as n from based group by 1),
  grown as (
    select g, item as items, item as last, 1 as k, tids from tid join n using (g)
      where len(tids) / n >= {floor}
    union all
    select g, items, last, k, tids from (
      select r.g, r.items || '|' || t.item as items, t.item as last, k + 1 as k,
        list_intersect(r.tids, t.tids) as tids
      from grown r join tid t on r.g = t.g and t.item > r.last) join n using (g)
      where len(tids) / n >= {floor}),
  frequent as (select g as density, items, k, len(tids) as f, len(tids) / n as support
    from grown join n using (g))"""


_FREQUENT = f"""with recursive {_TX}, based as (select key, item from base), {_mined("0.02")}"""


def _itemsets(t, min_support=0.02, tx=None):
    return N.frequent_itemsets(N.transactions(_lines(t), "key") if tx is None else tx, min_support)


@query(_FREQUENT + """ select items, f as frequency, round(support, 6) as support from frequent""")
def frequent_itemsets(t):
    return _itemsets(t).select(
        F.array_join("items", "|").alias("items"), "frequency",
        F.round("support", 6).alias("support"),
    )


_FREQBIN = f"""with recursive {_BINS},
  based as (select key, item, density from base join binned using (key)),
  {_mined("case when g = 'extreme' then 0.02 else 0.04 end", "density")}"""


def _by_density(t):
    return N.mine_by_density(N.transactions(_lines(t), "key"), 0.04)


@query(_FREQBIN + " select density, items, f as frequency, round(support, 6) as support from frequent")
def itemsets_by_density(t):
    return _by_density(t).select(
        "density", F.array_join("items", "|").alias("items"), "frequency",
        F.round("support", 6).alias("support"),
    )


@query(_FREQBIN + """, one as (select density, items, support from frequent where k = 1),
  lifted as (select f.density, f.items, f.support, case when k = 1 then 1.0 else f.support /
    (select list_reduce(list(o.support order by o.items), lambda a, b: a * b) from one o where o.density = f.density
      and list_contains(string_split(f.items, '|'), o.items)) end as lift, k from frequent f)
  select density, items, round(lift + 1e-9, 5) as lift from lifted where lift >= 1.1 or k = 1""")
def lifted_itemsets(t):
    kept = N.filter_by_lift(_by_density(t), 1.1, ["density"])
    return kept.select(
        "density", F.array_join("items", "|").alias("items"), F.round(F.col("lift") + 1e-9, 5).alias("lift")
    )


@query(_FREQBIN + """, m as (select *, row_number() over (partition by items order by
    list_position(['low', 'medium', 'high', 'extreme'], density)) as r from frequent)
  select items, density, round(support, 6) as support, row_number() over (order by support desc,
    string_split(items, '|')) - 1 as rank from m where r = 1""")
def merged_itemsets(t):
    merged = N.merge_bins(_by_density(t))
    return merged.select(
        F.array_join("items", "|").alias("items"), "density",
        F.round("support", 6).alias("support"), "rank",
    )


@query(_FREQBIN + """, m as (select *, row_number() over (partition by items order by
    list_position(['low', 'medium', 'high', 'extreme'], density)) as r from frequent),
  ranked as (select items, k, support, row_number() over (order by support desc,
    string_split(items, '|')) - 1 as rank from m where r = 1)
  select items as item, round(support, 6) as support, rank from ranked where k = 1""")
def item_encoding_map(t):
    return N.encoding_map(N.merge_bins(_by_density(t))).withColumn(
        "support", F.round("support", 6)
    )


# rules of itemsets of any size: every listed subset is an antecedent, the rest its consequent
_RULES = _FREQUENT + """, sets as (select items, string_split(items, '|') as l, k, support from frequent),
  rules as (select a.items as antecedents, c.items as consequents, a.support as sa, c.support as sc,
    f.support as support, f.support / a.support as confidence from sets f
    join sets a on a.k < f.k and list_has_all(f.l, a.l)
    join sets c on c.items = array_to_string(list_filter(f.l, lambda x: not list_contains(a.l, x)), '|')
    where f.support / a.support >= {conf})"""
_METRICS = """round(support, 6) as support, round(confidence, 6) as confidence,
  round(confidence / sc, 6) as lift, round(support - sa * sc, 6) as leverage,
  round((1 - sc) / (1 - confidence), 6) as conviction,
  round((confidence - sc) / (1 - sc), 6) as certainty"""


def _rounded(rules):
    return rules.select(
        F.array_join("antecedents", "|").alias("antecedents"),
        F.array_join("consequents", "|").alias("consequents"),
        *[F.round(m, 6).alias(m) for m in
          ("support", "confidence", "lift", "leverage", "conviction", "certainty")],
        *[c for c in rules.columns if c in ("rule_target", "min_support")],
    )


@query(_RULES.format(conf=0.15) + f" select antecedents, consequents, {_METRICS} from rules")
def association_rules(t):
    return _rounded(N.association_rules(_itemsets(t), 0.15))


@query(_RULES.format(conf=0.01) + f""", best as (select *, confidence / sc as l from rules
    order by round(l, 9) desc, support desc, antecedents, consequents limit 40)
  select antecedents, consequents, {_METRICS} from best""")
def top_rules(t):
    rules = N.association_rules(_itemsets(t), 0.01)
    return _rounded(N.top_rules(rules.withColumn("lift", F.round("lift", 9)), 40))


_SPLIT = _RULES.format(conf=0.01) + """, lab as (select *, confidence / sc as l,
    case when consequents like 'Brand#3%' then 'THREE' when consequents like 'Brand#4%' then 'FOUR'
      else 'CONTROL' end as rule_target from rules),
  best as (select *, row_number() over (partition by rule_target order by round(l, 9) desc,
    support desc, antecedents, consequents) as r from lab)"""


@query(_SPLIT + f" select antecedents, consequents, {_METRICS}, rule_target from best where r <= 10")
def split_rules(t):
    rules = N.association_rules(_itemsets(t), 0.01)
    rules = rules.withColumn("lift", F.round("lift", 9))
    return _rounded(N.split_rules(rules, {"THREE": "Brand#3", "FOUR": "Brand#4"}, 10))


@query(_RULES.format(conf=0.14).replace("from frequent)", "from topk)").replace(
    "sets as", "topk as (select * from frequent order by support desc, string_split(items, '|') limit 60), sets as"
) + f""", rung as (select max(r) as r
    from (select unnest([0.04, 0.035, 0.03, 0.025, 0.02]) as r), (select max(support) as s from rules)
    where r <= s)
  select antecedents, consequents, {_METRICS}, r as min_support from rules, rung where support >= r""")
def rules_with_fallback(t):
    tx = N.transactions(_lines(t), "key")
    return _rounded(N.mine_with_fallback(tx, 0.04, 0.02, 0.005, 60, 0.14))


@query(_RULES.format(conf=0.01) + """ select antecedents as source, consequents as target,
  round(avg(support), 6) as support, round(avg(confidence), 6) as confidence,
  round(avg((confidence - sc) / (1 - sc)), 6) as certainty from rules group by 1, 2""")
def rule_network_edges(t):
    edges, _ = N.rule_network(N.association_rules(_itemsets(t), 0.01))
    return edges.select(
        "source", "target",
        *[F.round(m, 6).alias(m) for m in ("support", "confidence", "certainty")],
    )


@query(_RULES.format(conf=0.15) + """, d as (select item, count(*) as degree from (
    select antecedents as item from rules union all select consequents from rules) group by 1)
  select item, degree, round(degree / greatest(count(*) over () - 1, 1), 6) as centrality from d""")
def rule_network_nodes(t):
    _, nodes = N.rule_network(N.association_rules(_itemsets(t), 0.15))
    return nodes.withColumn("centrality", F.round("centrality", 6))


@query(f"""with {Q._FACT} select person, code as item, count(*) as n from (
    select person, code_1 as code from fact where event_type = 'medical'
    union all select person, code_2 from fact where event_type = 'medical'
    union all select person, code_3 from fact where event_type = 'medical')
  where code <> '' group by all""")
def medical_items(t):
    rows = N.items(Q.facts(t), "person", "medical_code", icd_slots=["code_1", "code_2"],
                   cpt_slots=["code_3"])
    return rows.groupBy("person", "item").agg(F.count("*").alias("n"))


@query(f"""with {Q._FACT}, base as (select person, drug_name as item from fact
    where event_type = 'pharmacy'),
  marked as (select distinct person, 'TARGET_ICD:OPIOID_DEPENDENCE' as item from fact
    where replace(replace(upper(code_1), '.', ''), ' ', '') like 'BRAND#1%'
    union select person, 'TARGET_ED:EMERGENCY_DEPT' from fact where priority = '1-URGENT')
  select item, count(*) as n, count(distinct person) as persons
  from (select * from base union all select * from marked) group by 1""")
def target_markers(t):
    fact = Q.facts(t)
    rows = N.items(fact, "person", "drug_name")
    marked = N.add_markers(
        rows, fact, "person", "code_1", ["Brand#1"], "priority", ["1-URGENT"]
    )
    return marked.groupBy("item").agg(
        F.count("*").alias("n"), F.countDistinct("person").alias("persons")
    )


@query(f"""with recursive {Q._COHORT}, based as (select distinct person as key, code_1 as item
    from cohort where is_target_case = 1 and event_type = 'medical'), {_mined("0.7")}
  select items, f as frequency, round(support, 6) as support from frequent""")
def target_itemsets(t):
    rows = N.items(Q._cohort(t), "person", "icd_code", icd_slots=["code_1"],
                   keep=["is_target_case"])
    found, _ = N.mine_target(rows, "person", "is_target_case", 0.7, 0.5)
    return found.select(
        F.array_join("items", "|").alias("items"), "frequency",
        F.round("support", 6).alias("support"),
    )


@query(f"""with recursive {Q._FACT}, based as (
    select distinct person as key, drug_name as item from fact where event_type = 'pharmacy'
    union select person, 'TARGET_ICD:OPIOID_DEPENDENCE' from fact
      where replace(replace(upper(code_1), '.', ''), ' ', '') like 'BRAND#1%'
    union select person, 'TARGET_ED:EMERGENCY_DEPT' from fact where priority = '1-URGENT'),
  {_mined("0.6")}, sets as (select items, string_split(items, '|') as l, k, support from frequent),
  kept as (select * from (select s.*, support / (select list_reduce(list(o.support order by o.items), lambda a, b: a * b) from frequent o
      where o.k = 1 and list_contains(s.l, o.items)) as lift from sets s where k > 1) where lift >= 1.0005),
  rules as (select a.items as antecedents, c.items as consequents, a.support as sa, c.support as sc,
    f.support, f.support / a.support as confidence from kept f
    join sets a on a.k < f.k and list_has_all(f.l, a.l)
    join sets c on c.items = array_to_string(list_filter(f.l, lambda x: not list_contains(a.l, x)), '|')
    where f.support / a.support >= 0.5)
select antecedents, consequents, round(support, 6) as support, round(confidence, 6) as confidence,
  round(confidence / sc, 6) as lift, round(support - sa * sc, 6) as leverage,
  case when confidence < 1 then round(least((1 - sc) / (1 - confidence), 1e6), 6) else 1e6 end as conviction,
  case when sc < 1 then round((confidence - sc) / (1 - sc), 6) else 0 end as certainty,
  case when consequents like '%TARGET_ICD:%' then 'TARGET_ICD'
    when consequents like '%TARGET_ED:%' then 'TARGET_ED' else 'CONTROL' end as rule_target from rules
union all
select antecedents, consequents, round(support, 6), round(confidence, 6),
  round(confidence / sc, 6), round(support - sa * sc, 6),
  case when confidence < 1 then round(least((1 - sc) / (1 - confidence), 1e6), 6) else 1e6 end,
  case when sc < 1 then round((confidence - sc) / (1 - sc), 6) else 0 end, 'TARGET_ED' from rules
where consequents like '%TARGET_ICD:%' and consequents like '%TARGET_ED:%'""")
def marked_rules(t):
    """Rules with target markers; a rule that predicts both markers is listed under both."""
    fact = Q.facts(t)
    rows = N.items(fact, "person", "drug_name")
    marked = N.add_markers(rows, fact, "person", "code_1", ["Brand#1"], "priority", ["1-URGENT"])
    _, rules = N.mine_marked(marked, "person", 0.6, 0.5, 1.0005)
    rules = rules.withColumn("conviction", F.least("conviction", F.lit(1e6)))
    return _rounded(N.split_rules(
        rules, {"TARGET_ICD": "TARGET_ICD:", "TARGET_ED": "TARGET_ED:"}, None
    ))


_PATTERNS = _RULES.format(conf=0.01) + """, pats as (select items, support, row_number() over (
    order by support desc, string_split(items, '|')) as slot from frequent where k = 2),
  means as (select items, avg(confidence) as mc from (select antecedents as items, confidence from rules
    union all select consequents, confidence from rules) group by 1)"""


def _patterns(t, tx=None):
    found = _itemsets(t, tx=tx)
    pairs = found.filter(F.size("items") == 2).withColumn("d", -F.col("support"))
    slots = N.with_position(
        pairs, [], [F.col("d"), F.col("items")], F.floor(F.col("d") * 1000), "slot"
    )
    return slots.select("slot", "items", "support"), N.association_rules(found, 0.01)


@query(_PATTERNS + """, held as (select slot, key, p.support from pats p join base a on a.item = split_part(p.items, '|', 1)
    join base b using (key) where b.item = split_part(p.items, '|', 2) and slot <= 3)
  select key, coalesce(max(h.support) filter (slot = 1), 0) as pattern_1_support,
    coalesce(max(h.support) filter (slot = 2), 0) as pattern_2_support,
    coalesce(max(h.support) filter (slot = 3), 0) as pattern_3_support
  from sized left join held h using (key) group by 1""")
def pattern_features(t):
    patterns, _ = _patterns(t)
    tx = N.transactions(_lines(t), "key")
    return N.expand_patterns(tx, patterns, ["support"], n=3).drop("items", "size")


@query(_PATTERNS + """ select one.items, round(one.support, 6) as support,
  round(coalesce(mc, 0), 6) as mean_confidence from sets one left join means using (items) where one.k = 1""")
def pattern_metrics(t):
    found = _itemsets(t)
    rules = N.association_rules(found, 0.01)
    singles = found.filter(F.size("items") == 1).select("items", "support")
    return N.pattern_metrics(singles, rules).select(
        F.array_join("items", "|").alias("items"), F.round("support", 6).alias("support"),
        F.round("mean_confidence", 6).alias("mean_confidence"),
    )


@query("""
with pats as (select l_returnflag as pattern_id, avg(l_discount) as support, avg(l_tax) as confidence
  from lineitem group by 1)
select l_linestatus, round(sum(a.support), 4) as first_support, round(sum(b.confidence), 4) as second_confidence
from (select l_linestatus, l_returnflag as p1, case when l_quantity > 25 then 'A' else 'zz' end as p2
  from lineitem) l left join pats a on p1 = a.pattern_id left join pats b on p2 = b.pattern_id group by 1""")
def attached_pattern_metrics(t):
    patterns = t.lineitem.groupBy(F.col("l_returnflag").alias("pattern_id")).agg(
        F.avg("l_discount").alias("support"), F.avg("l_tax").alias("confidence")
    )
    rows = t.lineitem.select(
        "l_linestatus", F.col("l_returnflag").alias("p1"),
        F.when(F.col("l_quantity") > 25, "A").otherwise("zz").alias("p2"),
    )
    out = N.attach_pattern_metrics(rows, patterns, ["p1", "p2"], ["support", "confidence"])
    return out.groupBy("l_linestatus").agg(
        F.round(F.sum("support_p1"), 4).alias("first_support"),
        F.round(F.sum("confidence_p2"), 4).alias("second_confidence"),
    )


@query("""
with names as (select distinct replace(p_name, ' ', '_') as name from part),
pats as (select p_type as pattern, replace(p_name, ' ', '_') as name from part where p_size > 45
  group by all)
select pattern, cast(sum(length(name)) as bigint) as enc_length,
  cast(sum(len(regexp_extract_all(name, '[-_]'))) as bigint) as enc_separators
from pats join names using (name) group by 1""")
def encoded_patterns(t):
    names = t.part.select(F.translate("p_name", " ", "_").alias("item")).distinct()
    encodings = names.withColumn("encoding", D.encode_drug("item", {}))
    patterns = t.part.filter("p_size > 45").groupBy(F.col("p_type").alias("pattern")).agg(
        F.collect_set(F.translate("p_name", " ", "_")).alias("items")
    )
    out = N.encode_pattern(patterns, "pattern", "items", encodings)
    return out.select("pattern", "enc_length", "enc_separators")
