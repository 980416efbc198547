"""Feature, importance, evaluation and explanation queries on persons (customers) and documents."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from careloom.operators import evaluation as V
from careloom.operators import explain as X
from careloom.operators import features as R
from careloom.operators import importance as I
from careloom.operators import mining as N
from careloom.plans import claims_queries as C
from careloom.plans import mining_queries as M
from careloom.plans.registry import query
from careloom.session import cut_lineage

FEATURES = ["n_orders", "avg_total", "urgent", "n_open", "balance"]

_PERSONS = """persons as (select o_custkey as person, cast(count(*) as double) as n_orders,
    avg(o_totalprice) as avg_total, cast(max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as double) as urgent,
    cast(count(*) filter (o_orderstatus = 'O') as double) as n_open, max(c_acctbal) as balance,
    cast(max(case when o_totalprice > 480000 then 1 else 0 end) as integer) as label
  from orders join customer on o_custkey = c_custkey group by 1)"""


def _persons(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("o_custkey").alias("person")).agg(
        F.count("*").cast("double").alias("n_orders"),
        F.avg("o_totalprice").alias("avg_total"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("n_open"),
        F.max("c_acctbal").alias("balance"),
        F.max((F.col("o_totalprice") > 480000).cast("int")).alias("label"),
    )


# --- person-item features -----------------------------------------------------------------

_ITEMS = f"""{C._COHORT}, raw as (
    select person, code_1 as item, event_year from cohort union all select person, code_2, event_year from cohort
    union all select person, drug_name, event_year from cohort),
  allitems as (select person, item, event_year from raw where item <> '' and item not in ('PROMO', '1-URGENT')),
  items as (select person, item, count(*) as n from allitems where item in (
    select item from allitems where event_year <= 1998 group by 1 having count(distinct person) >= 500)
    group by 1, 2)"""


def _items(t):
    cohort = C._cohort(t)
    return R.patient_items(
        cohort, "person", ["code_1", "code_2", "drug_name"], ["PROMO", "1-URGENT"], 500,
        train=cohort.filter("event_year <= 1998"),
    )


@query(f"with {_ITEMS} select person, item, n from items")
def person_items(t):
    return _items(t)


_COLS = ["SMALL", "LARGE", "3-MEDIUM"]


@query(f"""with {_ITEMS}, ids as (select item, row_number() over (order by item) - 1 as i from (select distinct item from items)),
  rows as (select person, array_to_string(list(i order by i), '|') as indices, array_to_string(list(n order by i), '|') as values
    from items join ids using (item) group by 1)
select person, coalesce(indices, '') as indices, coalesce(values, '') as values
from (select distinct person from cohort) left join rows using (person)""")
def sparse_features(t):
    """Every item of the vocabulary, as numbered counts per person."""
    out = R.sparse_features(_items(t), C._cohort(t), "person")
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in ("indices", "values")})


@query(f"""with {_ITEMS}, ids as (select item, row_number() over (order by item) - 1 as i from (select distinct item from items)),
  rows as (select person, array_to_string(list(i order by i), '|') as indices, array_to_string(list(1 order by i), '|') as levels,
    array_to_string(list(item order by i), '|') as categories from items join ids using (item) group by 1)
select person, coalesce(indices, '') as indices, coalesce(levels, '') as levels, coalesce(categories, '') as categories
from (select distinct person from cohort) left join rows using (person)""")
def categorical_features(t):
    """Every item of the vocabulary as a category: its number, level and name per person."""
    out = R.sparse_categories(_items(t), C._cohort(t), "person")
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in ("indices", "levels", "categories")})


@query(f"""with {_ITEMS}, graded as (select person, item, case when n > 2 then 'many' when n = 2 then 'two' else 'one' end as v from items),
  ids as (select item, row_number() over (order by item) - 1 as i from (select distinct item from items)),
  lev as (select item, v, row_number() over (partition by item order by v) as l from (select distinct item, v from graded)),
  rows as (select person, array_to_string(list(i order by i), '|') as indices, array_to_string(list(l order by i), '|') as levels
    from graded join ids using (item) join lev using (item, v) group by 1)
select person, coalesce(indices, '') as indices, coalesce(levels, '') as levels
from (select distinct person from cohort) left join rows using (person)""")
def graded_features(t):
    """Every item of the vocabulary as a category of how often the person has it."""
    grade = F.when(F.col("n") > 2, "many").when(F.col("n") == 2, "two").otherwise("one")
    out = R.sparse_categories(_items(t).withColumn("grade", grade), C._cohort(t), "person", "grade").drop("categories")
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in ("indices", "levels")})


@query(f"""with {_ITEMS} select person, """ + ", ".join(
    f"""coalesce(max(n) filter (item = '{c}'), 0) as "{c}\"""" for c in _COLS)
    + " from (select distinct person from cohort) left join items using (person) group by 1")
def count_matrix(t):
    return R.feature_matrix(_items(t), C._cohort(t), "person", _COLS)


@query(f"""with {_ITEMS} select person, """ + ", ".join(
    f"""coalesce(max(item) filter (item = '{c}'), '') as "{c}\"""" for c in _COLS)
    + " from (select distinct person from cohort) left join items using (person) group by 1")
def categorical_matrix(t):
    return R.feature_matrix(_items(t), C._cohort(t), "person", _COLS, "categorical")


@query(f"""with {_ITEMS}, flat as (select person, item, 1 as n from items),
  c as (select item, count(distinct n) + case when count(*) < (select count(distinct person) from cohort)
    then 1 else 0 end as n_values from flat group by 1),
  constant as (select * from c where n_values <= 1)
select item, count(*) as persons, item in (select item from constant) as is_constant
from items group by 1""")
def constant_features(t):
    items = cut_lineage(_items(t))
    flags = items.withColumn("n", F.lit(1))
    constant = R.constant_features(flags, C._cohort(t), "person")
    kept = R.drop_features(items, constant, items).select("item").distinct()
    counts = items.groupBy("item").agg(F.count("*").alias("persons"))
    return counts.join(kept.withColumn("__k", F.lit(True)), "item", "left").select(
        "item", "persons", F.col("__k").isNull().alias("is_constant")
    )


@query(f"""with {_PERSONS}, s as (select unnest([1, 2, 3]) as split),
  ranked as (select split, person, label, row_number() over (partition by split, label
    order by md5('42:' || split || ':' || person), person) as r from persons, s),
  sizes as (select label, floor(count(*) * 0.8) as keep from persons group by 1)
select split, person, label from ranked join sizes using (label) where r <= keep""")
def mc_splits(t):
    return R.mc_splits(_persons(t).select("person", "label"), "person", "label", 3, 0.8)


@query(f"""with {C._COHORT}, base as (select person, max(is_target_case) as is_target_case from cohort group by 1),
  pre as (select person, count(*) as n_events, count(distinct code_1) as n_codes from cohort
    where event_type = 'medical' group by 1),
  post as (select person, count(*) as n_events from cohort where event_type = 'pharmacy' group by 1)
select base.*, pre.n_events as n_events_pre, pre.n_codes as n_codes_pre, post.n_events as n_events_post
from base left join pre using (person) left join post using (person) where is_target_case = 1""")
def final_features(t):
    cohort = C._cohort(t)
    base = cohort.groupBy("person").agg(F.max("is_target_case").alias("is_target_case"))
    pre = cohort.filter("event_type = 'medical'").groupBy("person").agg(
        F.count("*").alias("n_events"), F.countDistinct("code_1").alias("n_codes")
    )
    post = cohort.filter("event_type = 'pharmacy'").groupBy("person").agg(
        F.count("*").alias("n_events")
    )
    return R.final_features(base, {"pre": pre, "post": post}, "person")


# --- scores of predictions ----------------------------------------------------------------

_SCORES = """scores as (select l.doc_id, quality as label, least(0.999, n_chars / 4000.0) as score,
  lang from labels l join documents d on l.doc_id = d.doc_id)"""


def _scores(t):
    score = F.least(F.lit(0.999), F.col("n_chars") / 4000.0)
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), score.alias("score"), "lang"
    )


@query(f"""with {_SCORES} select lang,
  coalesce(count(*) filter (label = 1 and score >= 0.5) / nullif(count(*) filter (label = 1), 0), 0)
    as recall,
  round(avg(case when label = 1 then -ln(greatest(least(score, 1 - 1e-15), 1e-15))
    else -ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)) end), 5) as log_loss
  from scores group by 1""")
def recall_and_log_loss(t):
    rows = _scores(t).withColumn("guess", (F.col("score") >= 0.5).cast("int"))
    return rows.groupBy("lang").agg(
        V.recall("label", "guess").alias("recall"),
        F.round(V.log_loss("label", "score"), 5).alias("log_loss"),
    )


@query(f"""with {_SCORES}, g as (select score, count(*) filter (label = 1) as pos,
    count(*) filter (label = 0) as neg from scores group by 1),
  r as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
    sum(pos) over () as p, sum(neg) over () as n from g),
  k as (select sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)) as auc,
    sum(pos / p * tp / (tp + fp)) as ap, max_by(score, (round(tp / p - fp / n, 12), score)) as thr,
    max(tp / p - fp / n) as j from r),
  c as (select count(*) filter (score >= 0.4 and label = 1) as tp, count(*) filter (score >= 0.4 and label = 0) as fp,
    count(*) filter (score < 0.4 and label = 1) as fn, count(*) filter (score < 0.4 and label = 0) as tn,
    avg((score - label) ** 2) as brier from scores)
select round(auc, 6) as auc, round(ap, 6) as average_precision, round(thr, 6) as youden_threshold,
  round(j, 6) as youden_index, tp, fp, fn, tn, round(brier, 6) as brier,
  round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision,
  round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from k, c""")
def classification_metrics(t):
    out = V.classification_metrics(_scores(t), "label", "score", 0.4).drop("log_loss")
    counts = {"tp", "fp", "fn", "tn"}
    return out.select(
        *[F.col(c) if c in counts else F.round(c, 6).alias(c) for c in out.columns]
    )


@query(f"""with {_SCORES}, g as (select score, avg(label) as y, count(*) as w from scores group by 1),
  n as (select score, row_number() over (order by score) as i, sum(w) over (order by score) as cw,
    sum(w * y) over (order by score) as cy, w, y from g),
  mean as (select a.i as j, b.i as k, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) as m
    from n a join n b on b.i >= a.i),
  low as (select j, k, min(m) over (partition by j order by k desc) as m from mean),
  fit as (select k as i, max(m) as calibrated from low group by 1)
select doc_id, label, round(s.score, 6) as score, round(calibrated, 6) as calibrated
from scores s join n on s.score = n.score join fit on n.i = fit.i""")
def calibrated_scores(t):
    out = V.calibrate(_scores(t), "label", "score", ["doc_id"])
    return out.select(
        "doc_id", F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"),
        F.round("calibrated", 6).alias("calibrated"),
    )


@query(f"""with {_SCORES} select round(avg((score - label) ** 2), 6) as brier, count(*) as n from scores""")
def brier_score(t):
    return _scores(t).agg(
        F.round(V.brier("label", "score"), 6).alias("brier"), F.count("*").alias("n")
    )


@query(f"""with {_SCORES} select lang as model, round(avg(case when score >= 0.5 then 1 else 0 end), 6) as mean_recall
from scores where label = 1 group by 1 order by 2 desc, 1 limit 1""")
def best_model(t):
    hits = _scores(t).filter("label = 1").select(
        F.col("lang").alias("model"), (F.col("score") >= 0.5).cast("int").alias("recall")
    )
    return V.best_model(hits).withColumn("mean_recall", F.round("mean_recall", 6))


@query(f"""with {_PERSONS} select * from (""" + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as correlation from persons"
    for a in FEATURES for b in FEATURES) + ")")
def correlation_matrix(t):
    out = V.correlation_matrix(_persons(t), FEATURES)
    return out.withColumn("correlation", F.round("correlation", 6))


@query(f"""with {_PERSONS} """ + " union all ".join(
    f"""select label, '{a}' as feature, round(min({a}), 4) as min, round(max({a}), 4) as max,
    round(avg({a}), 4) as mean, round(stddev_samp({a}), 4) as std from persons group by label"""
    for a in FEATURES))
def feature_distributions(t):
    out = V.feature_distributions(_persons(t), FEATURES, ["label"])
    return out.withColumns({c: F.round(c, 4) for c in ("min", "max", "mean", "std")})


# --- importance ---------------------------------------------------------------------------

_RESULTS = f"""{_PERSONS}, results as (select 'lang_' || lang as method, source as feature,
    avg(n_chars) / 1000 as importance_mean, 0.2 + 0.1 * length(lang) + avg(avg(n_chars)) over (partition by lang) / 100000 as recall_mean
  from documents group by lang, source)"""


def _results(t):
    from pyspark.sql.window import Window

    rows = t.documents.groupBy("lang", "source").agg(F.avg("n_chars").alias("a"))
    per_lang = F.avg("a").over(Window.partitionBy("lang"))
    return rows.select(
        F.concat(F.lit("lang_"), "lang").alias("method"), F.col("source").alias("feature"),
        (F.col("a") / 1000).alias("importance_mean"),
        (0.2 + 0.1 * F.length("lang") + per_lang / 100000).alias("recall_mean"),
    )


_AGG = _RESULTS + """, m as (select method, min(importance_mean) as lo, max(importance_mean) as hi,
    max(recall_mean) as perf from results group by 1),
  n as (select feature, sum(case when hi > lo then (importance_mean - lo) / (hi - lo) else 0 end * {weight}) as s
    from results join m using (method) group by 1),
  e as (select min(s) as lo, max(s) as hi, (select {best}(perf) from m) as best from n)
select feature, round(case when hi > lo then (s - lo) / (hi - lo) else 0 end, 6) as importance_normalized,
  round(case when hi > lo then (s - lo) / (hi - lo) else 0 end * best, 6) as importance_scaled from n, e"""


def _round_importance(df):
    return df.select(
        "feature", F.round("importance_normalized", 6).alias("importance_normalized"),
        F.round("importance_scaled", 6).alias("importance_scaled"),
    )


@query("with " + _AGG.format(weight="perf", best="max"))
def aggregated_importance(t):
    return _round_importance(I.aggregate_importance(_results(t), "recall"))


@query("with " + _AGG.format(weight="(1 / perf)", best="min"))
def aggregated_importance_by_loss(t):
    rows = _results(t).withColumnRenamed("recall_mean", "logloss_mean")
    return _round_importance(I.aggregate_importance(rows, "logloss"))


@query("with " + _RESULTS + """, top as (select *, row_number() over (partition by method order by
    importance_mean desc, feature) as r from results)
select feature, count(*) as n_age_bands, round(avg(importance_mean), 6) as mean_importance,
  round(stddev_samp(importance_mean), 6) as sd_importance, round(min(importance_mean), 6) as min_importance,
  round(max(importance_mean), 6) as max_importance, round(max(importance_mean) - min(importance_mean), 6) as range_importance,
  round(stddev_samp(importance_mean) / avg(importance_mean) * 100, 6) as cv_importance
from top where r <= 2 group by 1""")
def cross_band_summary(t):
    out = I.cross_band_summary(_results(t), "method", "feature", "importance_mean", 2)
    return out.select(
        "feature", "n_age_bands",
        *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("importance")],
    )


@query("with " + _RESULTS + """, f as (select feature, avg(importance_mean) as v from results group by 1),
  r as (select *, row_number() over (order by v desc, feature) as k, count(*) over () as n from f)
select feature, k as importance_rank, round(1 - (k - 1) / greatest(n - 1, 1), 6) as percentile from r""")
def importance_ranks(t):
    means = _results(t).groupBy("feature").agg(F.avg("importance_mean").alias("v"))
    out = I.importance_rank(means, "feature", "v")
    return out.select("feature", "importance_rank", F.round("percentile", 6).alias("percentile"))


@query("with " + _RESULTS + """, a as (select feature, max(importance_mean) as native_importance from results group by 1),
  b as (select feature, avg(importance_mean * recall_mean) as relative_importance from results group by 1),
  j as (select * from a join b using (feature))
select feature, round(native_importance, 6) as native_importance,
  round(relative_importance, 6) as relative_importance,
  round((select corr(native_importance, relative_importance) from j), 6) as correlation from j""")
def native_vs_explained(t):
    rows = _results(t)
    native = rows.groupBy("feature").agg(F.max("importance_mean").alias("native_importance"))
    explained = rows.withColumn(
        "relative_importance", F.col("importance_mean") * F.col("recall_mean")
    )
    out = I.native_vs_explained(native, explained)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "feature"})


def _models():
    return {
        "forest": RandomForestClassifier(numTrees=5, maxDepth=3, seed=7),
        "boosted": GBTClassifier(maxIter=3, maxDepth=3, seed=7),
    }


@query()
def mc_cv_importance(t):
    people = cut_lineage(_persons(t))
    results = I.mc_cv_importance(
        people, people, "person", "label", FEATURES, _models(), n_splits=2, metric="logloss"
    )
    return I.summarize_splits(results)


# --- rules and explanations ---------------------------------------------------------------


def _fitted(t):
    people = cut_lineage(_persons(t))
    table = I.assemble(people, FEATURES)
    model = RandomForestClassifier(
        labelCol="label", numTrees=4, maxDepth=3, seed=11
    ).fit(table)
    scored = model.transform(table).select("person", "label", "prediction", *FEATURES)
    return model, scored


def _explained(t):
    model, scored = _fitted(t)
    rules = X.tree_rules(t.spark, model)
    classed = rules.withColumn("prediction", F.round("prediction"))
    return model, classed, cut_lineage(X.explain(scored, classed, FEATURES))


@query()
def tree_rules(t):
    model, scored = _fitted(t)
    rules = X.tree_rules(t.spark, model)
    hits = X.match_rules(scored, rules, FEATURES).select(F.explode("matched").alias("rule_id"))
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("persons"))
    return rules.join(counts, "rule_id", "left").select(
        "tree", "rule_id", "prediction", F.coalesce("persons", F.lit(0)).alias("persons"),
        F.array_join(X.rule_text(FEATURES), " AND ").alias("conditions"),
    )


@query()
def explanations(t):
    _, _, explained = _explained(t)
    return explained.select(
        "person", "prediction", F.size("matched").alias("matched_rules"),
        F.array_join("explanation", " AND ").alias("explanation"),
    )


@query()
def explanation_metrics(t):
    _, _, explained = _explained(t)
    return X.explanation_metrics(X.explanation_steps(explained, "person"), "person")


@query()
def explanation_quality(t):
    _, _, explained = _explained(t)
    steps = X.explanation_steps(explained, "person")
    share = X.explanation_importance(steps, explained, "person")
    unstable = X.unstable_features(steps, explained, 0.5)
    return share.join(unstable, "feature", "left")


@query()
def unmatched_predictions(t):
    _, _, explained = _explained(t)
    return X.unmatched_rows(explained)


@query()
def feature_pair_interactions(t):
    _, _, explained = _explained(t)
    return X.pair_interactions(X.explanation_steps(explained, "person"), "person")


@query()
def counterfactual_effects(t):
    model, _, explained = _explained(t)
    return X.counterfactual_effect(model, explained, "person", FEATURES, target=0.0)


@query()
def mean_probability_change(t):
    model, scored = _fitted(t)
    return X.mean_abs_change(model, scored.drop("prediction"), "person", FEATURES)


@query()
def rule_change_effects(t):
    model, scored = _fitted(t)
    rules = X.tree_rules(t.spark, model)
    matched = X.match_rules(scored, rules, FEATURES)
    return X.rule_change_effect(model, matched, rules, "person", FEATURES)


@query()
def rule_validation(t):
    model, scored = _fitted(t)
    rules = X.tree_rules(t.spark, model)
    matched = X.match_rules(scored, rules, FEATURES)
    return X.rule_validation(matched, rules, "label", "prediction", ["n_orders", "balance"])


@query()
def rule_patterns(t):
    """Rules over pattern features, with the patterns their conditions name."""
    tx = cut_lineage(N.transactions(M._lines(t), "key"))
    patterns, _ = M._patterns(t, tx)
    patterns = cut_lineage(patterns)
    slots = patterns.agg(F.max("slot")).first()[0] or 0
    names = [f"pattern_{i}_support" for i in range(1, slots + 1)]
    # patterns see nothing but their own items: equal sets of these are expanded, fitted and scored once
    used = patterns.agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("u")).first()["u"]
    own = F.array_intersect("items", F.array(*[F.lit(x) for x in used]).cast("array<string>"))
    rows = tx.select("key", (F.col("size") > 6).cast("int").alias("label"), own.alias("items"))
    kinds = cut_lineage(rows.groupBy("items", "label").agg(F.count("*").cast("double").alias("weight")))
    table = N.expand_patterns(kinds, patterns, ["support"], n=slots)
    model = DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=3).fit(I.assemble(table, names))
    table = N.expand_patterns(kinds.select("items").distinct(), patterns, ["support"], n=slots)
    scored = model.transform(I.assemble(table, names)).select("items", "prediction", *names)
    rules = X.tree_rules(t.spark, model)
    matched = X.match_rules(scored, rules, names).select("items", "prediction", "matched", names[0])
    matched = cut_lineage(rows.join(matched, "items").drop("items"))
    metrics = X.rule_validation(matched, rules, "label", "prediction", names[:1])
    return X.rule_table(rules, metrics, names, patterns)


_PERMUTED = f"""{_PERSONS}, draws as (select p, person, n_orders, label from persons, (select unnest(range(1, 21)) as p)),
  byrow as (select p, label, row_number() over (partition by p order by md5('42-row:' || p || ':' || person), person) as r from draws),
  byvalue as (select p, n_orders, row_number() over (partition by p order by md5('42-value:' || p || ':' || person), person) as r from draws),
  drawn as (select p, abs(corr(n_orders, label)) as v from byrow join byvalue using (p, r) group by p),
  seen as (select abs(corr(n_orders, label)) as v from persons)"""


@query(f"""with {_PERMUTED} select 'n_orders' as feature, round(seen.v, 6) as observed,
  count(*) filter (drawn.v >= seen.v) / 20 as p_value from drawn, seen group by all""")
def permutation_significance(t):
    """Does n_orders relate to the label beyond chance? Importance: absolute correlation."""
    people = _persons(t).select("person", "n_orders", "label")

    def strength(rows, by):
        return rows.groupBy(by).agg(
            F.abs(V.correlation("n_orders", "label")).alias("importance")
        )

    out = I.permutation_test(people, "person", ["n_orders"], "n_orders", strength, n=20)
    return out.withColumn("observed", F.round("observed", 6))


# --- explanations of given rules: what follows a fit, without one --------------------------

_N_ORDERS, _BALANCE = FEATURES.index("n_orders"), FEATURES.index("balance")
_GIVEN_RULES = [
    (0, 0, 0.0, [(1, _N_ORDERS, True, 9.0)]),
    (0, 1, 0.0, [(2, _N_ORDERS, False, 12.0), (3, _BALANCE, True, 4000.0)]),
    (1, 2, 1.0, [(4, _BALANCE, False, 4000.0)]),
    (1, 3, 1.0, [(4, _BALANCE, False, 4000.0), (5, _N_ORDERS, False, 6.0)]),
    (1, 4, 1.0, [(2, _N_ORDERS, False, 12.0), (6, _BALANCE, False, 2000.0)]),
]
_GIVEN = f"""{_PERSONS}, predicted as (select *, case when balance > 4000
    or (n_orders > 12 and balance > 2000) then 1.0 else 0.0 end as prediction from persons),
  matched as (select *, list_filter(case when prediction = 1 then [
      case when balance > 4000 then 2 end, case when balance > 4000 and n_orders > 6 then 3 end,
      case when n_orders > 12 and balance > 2000 then 4 end]
    else [case when n_orders <= 9 then 0 end, case when n_orders > 12 and balance <= 4000 then 1 end] end,
    lambda x: x is not null) as m from predicted),
  explained as (select *, case when prediction = 0 and n_orders <= 9 then ['n_orders <= 9.0']
    when prediction = 0 and n_orders > 12 then ['n_orders > 12.0'] when prediction = 0 then []
    when balance > 4000 and n_orders > 12 then ['n_orders > 12.0', 'balance > 4000.0']
    when balance > 4000 then ['balance > 4000.0'] else ['n_orders > 12.0'] end as e from matched),
  steps as (select person, len(e) as length, unnest(range(len(e))) as position,
    split_part(unnest(e), ' ', 1) as feature from explained)"""


def _given(t):
    """Rules, and persons with predictions, matched rules and explanations."""
    rules = t.spark.createDataFrame(_GIVEN_RULES, X.RULE_SCHEMA)
    target = (F.col("balance") > 4000) | ((F.col("n_orders") > 12) & (F.col("balance") > 2000))
    people = _persons(t).withColumn("prediction", target.cast("double"))
    return rules, X.explain(people, rules, FEATURES)


@query(f"""with {_GIVEN} select person, prediction, array_to_string(m, '|') as matched,
  array_to_string(e, ' AND ') as explanation from explained""")
def given_rule_explanations(t):
    _, explained = _given(t)
    return explained.select(
        "person", "prediction", F.array_join(F.transform("matched", lambda x: x.cast("string")), "|").alias("matched"),
        F.array_join("explanation", " AND ").alias("explanation"),
    )


@query(f"""with {_GIVEN}, n as (select count(distinct person) as persons, count(*) as uses from steps)
select feature, count(*) as support, count(*) as coverage, round(avg(length), 6) as specificity,
  round(count(*) / any_value(persons), 6) as essentiality_ratio, cast(0 as bigint) as contrastive_instances,
  0.0 as stability, round(count(*) / any_value(uses), 6) as relative_importance,
  round(avg(position), 6) as avg_position, round(stddev_pop(position), 6) as position_std
from steps, n group by feature""")
def given_rule_metrics(t):
    _, explained = _given(t)
    out = X.explanation_metrics(X.explanation_steps(explained, "person"), "person")
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


@query(f"""with {_GIVEN}, share as (select feature, count(distinct person) as raw_count, count(*) as mentions from steps group by 1),
  n as (select count(*) as n from explained)
select feature, raw_count, round(raw_count / n, 6) as normalized,
  case when mentions < 0.5 * n then mentions end as mentions from share, n""")
def given_rule_quality(t):
    _, explained = _given(t)
    steps = X.explanation_steps(explained, "person")
    share = X.explanation_importance(steps, explained, "person")
    unstable = X.unstable_features(steps, explained, 0.5)
    return share.join(unstable, "feature", "left").withColumn("normalized", F.round("normalized", 6))


@query(f"""with {_GIVEN} select prediction, count(*) as total_predictions,
  count(*) filter (len(m) = 0) as unmatched_predictions from explained group by 1""")
def given_rule_unmatched(t):
    return X.unmatched_rows(_given(t)[1])


@query(f"""with {_GIVEN}, f as (select distinct person, feature from steps)
select a.feature as feature_a, b.feature as feature_b, count(*) as weight from f a
  join f b on a.person = b.person and a.feature < b.feature group by 1, 2 having count(*) >= 2""")
def given_rule_interactions(t):
    _, explained = _given(t)
    return X.pair_interactions(X.explanation_steps(explained, "person"), "person")


@query(f"""with {_GIVEN}, hits as (select unnest(m) as rule_id, * from matched), n as (select count(*) as n from matched)
select rule_id, case when rule_id < 2 then 0.0 else 1.0 end as rule_prediction, count(*) as matched_rows,
  round(stddev_pop(prediction), 6) as stability, round(avg(case when prediction = label then 1 else 0 end), 6) as accuracy,
  round(stddev_pop(balance), 4) as balance_std, round(max(balance) - min(balance), 4) as balance_range,
  round(avg(balance), 4) as balance_mean, round(count(*) / any_value(n), 6) as coverage
from hits, n group by 1, 2""")
def given_rule_validation(t):
    rules, explained = _given(t)
    out = X.rule_validation(explained, rules, "label", "prediction", ["balance"])
    return out.withColumns({c: F.round(c, 4 if c.startswith("balance") else 6) for c, kind in out.dtypes if kind == "double"})


@query(f"""with {_GIVEN}, hits as (select unnest(m) as rule_id from matched)
select rule_id, count(*) as persons from hits group by 1""")
def given_rule_matches(t):
    rules, _ = _given(t)
    target = (F.col("balance") > 4000) | ((F.col("n_orders") > 12) & (F.col("balance") > 2000))
    people = _persons(t).withColumn("prediction", target.cast("double"))
    hits = X.match_rules(people, rules, FEATURES, "prediction").select(F.explode("matched").alias("rule_id"))
    return hits.groupBy("rule_id").agg(F.count("*").alias("persons"))


class LinearScore(Transformer):
    """A fixed linear score that stands in for a fitted model: what SQL can say as well."""

    def _transform(self, dataset):
        x = vector_to_array("features")
        z = 0.3 * (x[_N_ORDERS] - 12) + (x[_BALANCE] - 4000) / 2000
        p = 1 / (1 + F.exp(-z))
        scored = dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return scored.withColumn("prediction", (p >= 0.5).cast("double"))


def _score(n_orders: str, balance: str) -> str:
    return f"1 / (1 + exp(-(0.3 * ({n_orders} - 12) + ({balance} - 4000) / 2000)))"


@query(f"""with {_GIVEN}, s as (select stddev_samp(n_orders) as sn, stddev_samp(balance) as sb from explained where prediction = 1),
  hit as (select e, n_orders, balance from explained where prediction = 1),
  flips as (select 'n_orders' as feature, count(*) as k from hit, s
      where list_contains(e, 'n_orders > 12.0') and {_score("n_orders + sign(n_orders) * sn", "balance")} < 0.5
    union all select 'balance', count(*) from hit, s
      where list_contains(e, 'balance > 4000.0') and {_score("n_orders", "balance + sign(balance) * sb")} < 0.5)
select feature, round(k / (select count(*) from hit), 6) as causal_responsibility from flips where k > 0""")
def given_counterfactuals(t):
    _, explained = _given(t)
    out = X.counterfactual_effect(LinearScore(), explained, "person", FEATURES, target=1.0)
    return out.withColumn("causal_responsibility", F.round("causal_responsibility", 6))


@query(f"""with {_PERSONS}, s as (select stddev_samp(n_orders) as sn, stddev_samp(balance) as sb from persons),
  changes as (select unnest(['n_orders', 'balance', 'avg_total', 'urgent', 'n_open']) as feature,
    unnest([abs({_score("n_orders + sn", "balance")} - {_score("n_orders", "balance")}),
      abs({_score("n_orders", "balance + sb")} - {_score("n_orders", "balance")}), 0.0, 0.0, 0.0]) as change
    from persons, s)
select feature, round(avg(change), 6) as causal_importance, round(stddev_samp(change), 6) as change_std
from changes group by 1""")
def given_probability_change(t):
    out = X.mean_abs_change(LinearScore(), _persons(t), "person", FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in ("causal_importance", "change_std")})


@query(f"""with {_GIVEN}, hits as (select unnest(m) as rule_id, * from matched),
  r as (select rule_id, coalesce(corr(n_orders, balance), 0) as r from hits group by 1),
  s as (select hits.*, case when abs(r) > 0.3 then r else 0 end as r,
      case rule_id when 0 then 9 + 1e-6 - n_orders when 1 then 12 - 1e-6 - n_orders when 3 then 6 - 1e-6 - n_orders
        when 4 then 12 - 1e-6 - n_orders else 0 end as sn,
      case rule_id when 1 then 4000 + 1e-6 - balance when 2 then 4000 - 1e-6 - balance when 3 then 4000 - 1e-6 - balance
        when 4 then 2000 - 1e-6 - balance else 0 end as sb from hits join r using (rule_id))
select rule_id, round(avg(abs(prediction - case when {_score("n_orders + sn + r * sb", "balance + sb + r * sn")} >= 0.5
  then 1 else 0 end)), 6) as causal_importance from s group by 1""")
def given_rule_changes(t):
    rules, explained = _given(t)
    out = X.rule_change_effect(LinearScore(), explained, rules, "person", FEATURES)
    return out.withColumn("causal_importance", F.round("causal_importance", 6))


class DebugText:
    """The text form of a fitted forest of two trees."""

    toDebugString = """RandomForestClassificationModel: uid=given, numTrees=2, numClasses=2, numFeatures=5
  Tree 0 (weight 1.0):
    If (feature 0 <= 9.0)
     Predict: 0.0
    Else (feature 0 > 9.0)
     If (feature 4 <= 4000.5)
      If (feature 0 <= 15.0)
       Predict: 0.0
      Else (feature 0 > 15.0)
       Predict: 1.0
     Else (feature 4 > 4000.5)
      Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 2 <= 0.5)
     Predict: 0.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""


@query(f"""with {_PERSONS}, leaves as (select * from (values
    (0, 0, 0.0, 'n_orders <= 9.0'), (0, 1, 0.0, 'n_orders > 9.0 AND balance <= 4000.5 AND n_orders <= 15.0'),
    (0, 2, 1.0, 'n_orders > 9.0 AND balance <= 4000.5 AND n_orders > 15.0'), (0, 3, 1.0, 'n_orders > 9.0 AND balance > 4000.5'),
    (1, 4, 0.0, 'urgent <= 0.5'), (1, 5, 1.0, 'urgent > 0.5')) v(tree, rule_id, prediction, conditions)),
  hits as (select unnest([case when n_orders <= 9 then 0 when balance > 4000.5 then 3 when n_orders <= 15 then 1 else 2 end,
    case when urgent <= 0.5 then 4 else 5 end]) as rule_id from persons)
select tree, leaves.rule_id, cast(prediction as double) as prediction, conditions, count(hits.rule_id) as persons
from leaves left join hits using (rule_id) group by all""")
def given_tree_rules(t):
    """Leaves of a given forest and the persons that fall into each."""
    rules = X.tree_rules(t.spark, DebugText())
    hits = X.match_rules(_persons(t), rules, FEATURES).select(F.explode("matched").alias("rule_id"))
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("persons"))
    return rules.join(counts, "rule_id", "left").select(
        "tree", "rule_id", "prediction", F.coalesce("persons", F.lit(0)).alias("persons"),
        F.array_join(X.rule_text(FEATURES), " AND ").alias("conditions"),
    )


@query("""with results as (select lang as method, source as feature, doc_id % 3 as split, avg(n_chars) / 1000 as importance,
    avg(n_chars) / 2000 as scaled_importance, 0.5 + (doc_id % 3) / 10 as recall, 1.0 as logloss
  from documents group by lang, source, doc_id % 3)
select method, feature, round(avg(scaled_importance), 6) as scaled_importance_mean,
  round(stddev_samp(scaled_importance), 6) as scaled_importance_std, count(*) as scaled_importance_count,
  round(avg(importance), 6) as importance_mean, round(stddev_samp(importance), 6) as importance_std,
  round(avg(recall), 6) as recall_mean, round(avg(logloss), 6) as logloss_mean from results group by 1, 2""")
def summarized_splits(t):
    """Means and deviations over the splits of a given result table."""
    split = F.col("doc_id") % 3
    rows = t.documents.groupBy(F.col("lang").alias("method"), F.col("source").alias("feature"), split.alias("split")).agg(F.avg("n_chars").alias("a"))
    results = rows.select(
        "method", "feature", "split", (F.col("a") / 1000).alias("importance"), (F.col("a") / 2000).alias("scaled_importance"),
        (0.5 + F.col("split") / 10).alias("recall"), F.lit(1.0).alias("logloss"),
    )
    out = I.summarize_splits(results)
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


_PATTERN_RULES = [
    (0, 0, 1.0, [(1, 0, False, 0.0)]),
    (0, 1, 0.0, [(2, 0, True, 0.0), (3, 1, False, 0.0)]),
    (0, 2, 0.0, [(2, 0, True, 0.0), (4, 1, True, 0.0), (5, 2, False, 0.0)]),
]


@query(M._PATTERNS + """, held as (select distinct slot, key from pats p join base a on a.item = split_part(p.items, '|', 1)
    join base b using (key) where b.item = split_part(p.items, '|', 2) and slot <= 3),
  flags as (select s.key, bool_or(slot = 1) as a, bool_or(slot = 2) as b, bool_or(slot = 3) as c
    from sized s left join held using (key) group by 1),
  hits as (select case when a then 0 when b then 1 when c then 2 end as rule_id, count(*) as matched_rows from flags group by 1)
select rule_id, matched_rows, round(matched_rows / (select count(*) from flags), 6) as coverage,
  case rule_id when 0 then 'pattern_1_support > 0.0' when 1 then 'pattern_1_support <= 0.0 AND pattern_2_support > 0.0'
    else 'pattern_1_support <= 0.0 AND pattern_2_support <= 0.0 AND pattern_3_support > 0.0' end as conditions,
  (select string_agg(replace(items, '|', '+'), '|' order by replace(items, '|', '+')) from pats where slot <= rule_id + 1) as patterns,
  round((select max(support) from pats where slot <= rule_id + 1), 6) as pattern_support
from hits where rule_id is not null""")
def given_rule_patterns(t):
    """Given rules over the features of all patterns, with the patterns that their conditions name."""
    tx = cut_lineage(N.transactions(M._lines(t), "key"))
    patterns, _ = M._patterns(t, tx)
    patterns = cut_lineage(patterns)
    slots = patterns.agg(F.max("slot")).first()[0] or 0
    names = [f"pattern_{i}_support" for i in range(1, slots + 1)]
    table = N.expand_patterns(tx, patterns, ["support"], n=slots)
    rules = t.spark.createDataFrame(_PATTERN_RULES, X.RULE_SCHEMA)
    matched = X.match_rules(table.withColumns({"label": F.lit(1), "prediction": F.lit(1.0)}), rules, names)
    metrics = X.rule_validation(matched, rules, "label", "prediction", []).select("rule_id", "matched_rows", "coverage")
    out = X.rule_table(rules, metrics, names, patterns)
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "pattern_support")})
