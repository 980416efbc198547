import math
import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from careloom.operators import evaluation as V
from careloom.operators import explain as X
from careloom.operators import features as R
from careloom.operators import importance as I
from conftest import rows


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(9)
    data = []
    for i in range(400):
        a, b, c = rnd.random(), rnd.random(), float(rnd.random() < 0.5)
        data.append((i, a, b, c, int(a + 0.1 * rnd.random() > 0.55 and c > 0 or a > 0.9)))
    return spark.createDataFrame(data, "id int, a double, b double, c double, label int").cache()


FEATURES = ["a", "b", "c"]


def test_recall_and_log_loss_edges(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 0.0), (0, 1, 0.5), (1, None, None)],
                               "y int, g int, p double")
    assert df.agg(V.recall("y", "g")).first()[0] == 0.5
    loss = df.agg(V.log_loss("y", "p")).first()[0]
    assert math.isclose(loss, (-math.log(1 - 1e-15) - math.log(1e-15) + math.log(2)) / 3, rel_tol=1e-6)
    empty = df.filter("y = 9")
    assert empty.agg(V.recall("y", "g"), V.log_loss("y", "p")).first() == (0.0, float("inf"))


def test_auc_counts_ties_half(spark):
    rnd = random.Random(2)
    data = [(int(rnd.random() < 0.4), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = V.ranking_metrics(df, "y", "s").first()
    assert math.isclose(got["auc"], auc)
    best = max((sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg), t)
               for t in {s for _, s in data})
    assert math.isclose(got["youden_index"], best[0])


def test_single_class_labels(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    row = V.threshold_metrics(df, "y", "s").first()
    assert (row["tp"], row["fn"], row["recall"], row["precision"]) == (1, 1, 0.5, 1.0)


def test_calibration_is_monotone_and_brier_in_range(spark, table):
    rowset = V.calibrate(table, "label", "a", ["id"]).orderBy("a").collect()
    values = [r["calibrated"] for r in rowset]
    assert values == sorted(values)
    brier = table.agg(V.brier("label", "a")).first()[0]
    assert 0 <= brier <= 1


def test_permutation_keeps_values(spark, table):
    out = I.permuted(table, "id", FEATURES, 3)
    own = sorted(r["a"] for r in table.collect())
    assert sorted(r["donor"]["a"] for r in out.collect()) == own
    assert out.filter("a <> donor.a").count() > 300


def test_importance_finds_the_feature(spark, table):
    models = {"forest": RandomForestClassifier(numTrees=5, maxDepth=4, seed=1)}
    results = I.mc_cv_importance(table, table, "id", "label", FEATURES, models, n_splits=2, metric="logloss")
    summary = I.summarize_splits(results)
    top = summary.orderBy(F.col("importance_mean").desc()).first()
    assert top["feature"] == "a" and top["scaled_importance_count"] == 2


def test_aggregate_importance_edges(spark):
    schema = "method string, feature string, importance_mean double, recall_mean double"
    flat = spark.createDataFrame([("m", "a", 1.0, 0.5), ("m", "b", 1.0, 0.5)], schema)
    assert rows(I.aggregate_importance(flat)) == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]
    two = spark.createDataFrame([("m", "a", 1.0, 0.5), ("m", "b", 3.0, 0.5), ("n", "a", 4.0, 0.0), ("n", "b", 2.0, 0.0)], schema)
    assert rows(I.aggregate_importance(two)) == [("a", 0.0, 0.0), ("b", 1.0, 0.5)]
    loss = two.withColumnRenamed("recall_mean", "logloss_mean")
    assert rows(I.aggregate_importance(loss, "logloss")) == [("a", 0.0, 0.0), ("b", 1.0, 0.5)]
    assert I.aggregate_importance(flat.limit(0)).count() == 0


def test_splits_are_stratified(spark, table):
    splits = R.mc_splits(table, "id", "label", 3, 0.8)
    sizes = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    for r in splits.groupBy("split", "label").count().collect():
        assert r["count"] == int(sizes[r["label"]] * 0.8)
    sets = [{r["id"] for r in splits.filter(F.col("split") == i).collect()} for i in (1, 2)]
    assert sets[0] != sets[1]


def test_matrix_and_constant_items(spark):
    items = spark.createDataFrame([(1, "x", 2), (2, "x", 2), (1, "y", 1)], "p int, item string, n int")
    persons = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    assert rows(R.feature_matrix(items, persons, "p", ["x", "y"])) == [(1, 2, 1), (2, 2, 0), (3, 0, 0)]
    assert rows(R.feature_matrix(items, persons, "p", ["x"], "categorical")) == [(1, "x"), (2, "x"), (3, "")]
    two = persons.filter("p < 3")
    constant = R.constant_features(items, two, "p")
    assert [r["item"] for r in constant.collect()] == ["x"]
    assert {r["item"] for r in R.drop_features(items, constant, items).collect()} == {"y"}


@pytest.fixture(scope="module")
def forest(spark, table):
    rows_ = I.assemble(table, FEATURES)
    model = RandomForestClassifier(numTrees=3, maxDepth=3, seed=5, labelCol="label").fit(rows_)
    scored = model.transform(rows_).select("id", "label", "prediction", *FEATURES)
    return model, scored, X.tree_rules(spark, model)


def test_each_row_matches_one_leaf_per_tree(spark, forest):
    model, scored, rules = forest
    matched = X.match_rules(scored, rules, FEATURES)
    trees = {r["rule_id"]: r["tree"] for r in rules.collect()}
    for r in matched.collect():
        assert sorted(trees[i] for i in r["matched"]) == [0, 1, 2]


def test_single_tree_rules_predict_like_the_model(spark, table):
    data = I.assemble(table, FEATURES)
    model = DecisionTreeClassifier(labelCol="label", maxDepth=4).fit(data)
    scored = model.transform(data).select("id", "prediction", *FEATURES)
    rules = X.tree_rules(spark, model)
    predictions = {r["rule_id"]: r["prediction"] for r in rules.collect()}
    for r in X.match_rules(scored, rules, FEATURES).collect():
        assert [predictions[i] for i in r["matched"]] == [r["prediction"]]


def test_hitting_set_is_irreducible():
    clauses = [frozenset(c) for c in ({1, 2}, {2, 3}, {4}, {3, 4})]
    chosen = set(X.hitting_set(clauses))
    assert all(chosen & c for c in clauses)
    assert all(any(not (chosen - {x}) & c for c in clauses) for x in chosen)
    assert X.hitting_set([]) == []


def test_explanations_touch_every_rule(spark, forest):
    model, scored, rules = forest
    explained = X.explain(scored, rules, FEATURES)
    texts = {r["rule_id"]: set(r["t"]) for r in
             rules.select("rule_id", X.rule_text(FEATURES).alias("t")).collect()}
    for r in explained.collect():
        assert all(set(r["explanation"]) & texts[i] for i in r["matched"])
    steps = X.explanation_steps(explained, "id")
    metrics = {r["feature"]: r for r in X.explanation_metrics(steps, "id").collect()}
    n = explained.filter(F.size("explanation") > 0).count()
    for f, m in metrics.items():
        assert m["support"] == m["coverage"] <= n and m["contrastive_instances"] == 0
        assert math.isclose(m["essentiality_ratio"], m["support"] / n)
    assert X.unmatched_rows(explained).agg(F.sum("total_predictions")).first()[0] == 400


def test_explanation_metrics_by_hand(spark):
    steps = spark.createDataFrame(
        [(1, 0, 2, 0, "a"), (1, 0, 2, 1, "b"), (1, 1, 1, 0, "a"), (2, 0, 1, 0, "b")],
        "id int, explanation_id int, length int, position int, feature string")
    got = {r["feature"]: r for r in X.explanation_metrics(steps, "id").collect()}
    assert (got["a"]["support"], got["a"]["essentiality_ratio"], got["a"]["specificity"]) == (1, 0.5, 1.5)
    assert (got["b"]["support"], got["b"]["contrastive_instances"], got["b"]["avg_position"]) == (2, 1, 0.5)
    assert rows(X.pair_interactions(steps, "id", 1)) == [("a", "b", 1)]


def test_effects(spark, forest):
    model, scored, rules = forest
    changes = {r["feature"]: r["causal_importance"] for r in
               X.mean_abs_change(model, scored.drop("prediction"), "id", FEATURES).collect()}
    assert set(changes) == set(FEATURES) and max(changes, key=changes.get) in ("a", "c")
    explained = X.explain(scored, rules, FEATURES)
    shares = X.counterfactual_effect(model, explained, "id", FEATURES).collect()
    assert all(0 < r["causal_responsibility"] <= 1 for r in shares)
    matched = X.match_rules(scored, rules, FEATURES)
    valid = X.rule_validation(matched, rules, "label", "prediction", ["a"]).collect()
    assert math.isclose(sum(r["coverage"] for r in valid), 3.0)
    effect = X.rule_change_effect(model, matched, rules, "id", FEATURES).collect()
    assert all(0 <= r["causal_importance"] <= 1 for r in effect)


def test_permutation_p_value(spark, table):
    def strength(df, by):
        return df.groupBy(by).agg(F.abs(V.correlation("a", "label")).alias("importance"))

    out = I.permutation_test(table.select("id", "a", "label"), "id", ["a"], "a", strength, n=10).first()
    assert out["p_value"] == 0.0 and out["observed"] > 0.3


def test_many_rules_match_like_their_conditions(spark):
    """Several groups of rules, nulls, NaN, equal thresholds, and rules without conditions."""
    rnd = random.Random(6)
    rules = []
    for i in range(300):
        literals = [(j, rnd.randrange(3), rnd.random() < 0.5, float(rnd.randrange(6))) for j in range(rnd.randrange(0, 5))]
        rules.append((0, 1000 + i, float(i % 2), literals))
    values = [[rnd.choice([None, float("nan"), *map(float, range(6)), 2.5]) for _ in range(3)] for _ in range(200)]
    data = [(i, *v, float(rnd.randrange(2))) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, prediction double").repartition(3)
    table = spark.createDataFrame(rules, X.RULE_SCHEMA)

    def holds(v, le, t):
        if v is None:
            return False
        return not math.isnan(v) and v <= t if le else math.isnan(v) or v > t

    for predicted in (None, "prediction"):
        for r in X.match_rules(df, table, FEATURES, predicted).collect():
            v = [r[f] for f in FEATURES]
            want = [i for _, i, p, own in rules if all(holds(v[f], le, t) for _, f, le, t in own) and (not predicted or p == r["prediction"])]
            assert r["matched"] == want


def test_masks_of_many_splits(spark, table):
    splits = R.mc_splits(table, "id", "label", 70, 0.5)
    masks = I.fold_masks(splits, "id", 70)
    for i in (1, 62, 63, 70):
        got = {r["id"] for r in masks.filter(I.in_split(i)).collect()}
        assert got == {r["id"] for r in splits.filter(F.col("split") == i).collect()}


def test_only_used_features_are_varied(spark, table):
    """Hundreds of features, three of which the model can use."""
    wide = table.select("*", *[F.lit(0.5).alias(f"w{i}") for i in range(300)])
    names = [*FEATURES, *[f"w{i}" for i in range(300)]]
    model = DecisionTreeClassifier(labelCol="label", maxDepth=3).fit(I.assemble(wide, names))
    assert set(I.used_features(model, len(names))) <= {0, 1, 2}
    few = {r["feature"]: r for r in X.mean_abs_change(model, wide, "id", names).collect()}
    assert len(few) == 303 and few["w7"]["causal_importance"] == 0.0 and few["a"]["causal_importance"] > 0
    results = I.mc_cv_importance(wide, wide, "id", "label", names, {"tree": DecisionTreeClassifier(maxDepth=3)}, n_splits=3, metric="logloss")
    assert results.count() == 3 * 303 and {r["importance"] for r in results.filter("feature like 'w%'").collect()} == {0.0}


def test_only_features_of_conditions_travel_to_the_search(spark):
    rules = spark.createDataFrame([(0, 7, 1.0, [(1, 2, False, 0.5)]), (0, 8, 1.0, [(2, 2, True, 0.5), (3, 0, False, 1.0)])], X.RULE_SCHEMA)
    data = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, 1.0, 0.0), (2.0, 1.0, None)], "a double, unread double, c double")
    matched = X.match_rules(data, rules, ["a", "unread", "c"]).select("matched")
    assert [r["matched"] for r in matched.collect()] == [[7], [8], []]
    assert "unread" not in matched._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_items_of_categories_are_built_once(spark):
    items = spark.range(6).selectExpr("id % 3 as person", "concat('i', id % 2) as item", "1L as n").distinct()
    persons = spark.createDataFrame([(i,) for i in range(4)], "person long")
    out = R.sparse_categories(items, persons, "person")
    assert rows(out.select("person", "indices", "levels")) == [(0, [0, 1], [1, 1]), (1, [0, 1], [1, 1]), (2, [0, 1], [1, 1]), (3, [], [])]
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
