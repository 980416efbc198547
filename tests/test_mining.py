import itertools
import math
import random

from pyspark.sql import functions as F

from careloom.operators import mining as N
from conftest import rows


def baskets(spark, data):
    return spark.createDataFrame(
        [(k, x) for k, items in enumerate(data) for x in items], "key int, item string")


def brute_itemsets(data, support):
    sets, n, out = [frozenset(b) for b in data], len(data), {}
    for size in range(1, 7):
        for combo in itertools.combinations(sorted(set().union(*sets)), size):
            f = sum(set(combo) <= s for s in sets)
            if f and f / n >= support:
                out[combo] = f / n
    return out


def sample_data():
    rnd = random.Random(3)
    return [[x for x in "abcdef" if rnd.random() < 0.55] or ["a"] for _ in range(60)]


def test_itemsets_and_all_rules(spark):
    data = sample_data()
    tx = N.transactions(baskets(spark, data + []), "key")
    found = N.frequent_itemsets(tx, 0.1)
    expected = brute_itemsets(data, 0.1)
    got = {tuple(r["items"]): r["support"] for r in found.collect()}
    assert set(got) == set(expected) and max(map(len, got)) >= 3
    assert all(math.isclose(got[k], expected[k]) for k in got)
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in
             N.association_rules(found, 0.4).collect()}
    want = {}
    for items, s in expected.items():
        for size in range(1, len(items)):
            for a in itertools.combinations(items, size):
                c = tuple(x for x in items if x not in a)
                if s / expected[a] >= 0.4:
                    want[(a, c)] = (s, s / expected[a], s / expected[a] / expected[c])
    assert set(rules) == set(want)
    for key, (s, conf, lift) in want.items():
        r = rules[key]
        assert math.isclose(r["confidence"], conf) and math.isclose(r["lift"], lift)
        assert math.isclose(r["leverage"], s - r["antecedents_support"] * r["consequents_support"], abs_tol=1e-12)


def test_support_never_grows_with_size(spark):
    found = N.frequent_itemsets(N.transactions(baskets(spark, sample_data()), "key"), 0.1)
    s = {tuple(r["items"]): r["support"] for r in found.collect()}
    assert all(s[k] <= s[tuple(x for x in k if x != y)] for k in s if len(k) > 1 for y in k)


def test_repeated_items_count_once_but_size_counts_rows(spark):
    tx = N.transactions(spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (1, "")], "key int, item string"), "key")
    assert rows(tx) == [(1, ["a", "b"], 3)]


def test_independent_pair_is_dropped_and_singletons_stay(spark):
    data = [["a", "b"], ["a"], ["b"], ["c"]] * 5
    found = N.frequent_itemsets(N.transactions(baskets(spark, data), "key"), 0.1)
    lifted = {tuple(r["items"]): r["lift"] for r in N.with_lift(found).collect()}
    assert lifted[("a",)] == 1.0 and math.isclose(lifted[("a", "b")], 1.0)
    kept = {tuple(r["items"]) for r in N.filter_by_lift(found, 1.1).collect()}
    assert kept == {("a",), ("b",), ("c",)}
    assert N.filter_by_lift(found, 1.1, drop_singletons=True).count() == 0


def test_density_bins_use_percentiles(spark):
    tx = spark.createDataFrame([(i, i + 1) for i in range(100)], "key int, size int")
    counts = {r["density"]: r["count"] for r in N.transaction_density(tx).groupBy("density").count().collect()}
    assert counts == {"low": 25, "medium": 25, "high": 45, "extreme": 5}


def test_every_bin_is_mined_however_small(spark):
    tx = spark.createDataFrame([(i, ["a"], 1 + i % 3) for i in range(12)], "key int, items array<string>, size int")
    bins = {r["density"] for r in N.mine_by_density(tx, 0.1).collect()}
    sizes = {r["density"]: r["count"] for r in N.transaction_density(tx).groupBy("density").count().collect()}
    assert bins == set(sizes) and min(sizes.values()) < 10


def test_merge_keeps_the_first_bin(spark):
    df = spark.createDataFrame([(["a"], 0.2, "high"), (["a"], 0.1, "low"), (["b"], 0.3, "extreme")],
                               "items array<string>, support double, density string")
    assert rows(N.merge_bins(df).select("items", "support", "rank")) == [(["a"], 0.1, 1), (["b"], 0.3, 0)]


def test_small_cohorts_use_the_given_thresholds(spark):
    data = [["a", "b"], ["a", "b"], ["c"], ["c", "a"]]
    kept, rules = N.mine_marked(baskets(spark, data), "key", 0.05, 0.1, 1.1)
    # lift of {a, b} is 0.5 / (0.75 * 0.5), of {a, c} 0.25 / (0.75 * 0.5)
    assert rows(kept.select("items")) == [(["a", "b"],)] and rules.count() == 2
    kept, _ = N.mine_marked(baskets(spark, data), "key", 0.5, 0.1, 2.0)
    assert kept.count() == 0


def test_markers_and_split(spark):
    events = spark.createDataFrame([(1, "F11.20", None), (2, "A", "ED"), (3, "A", None)],
                                   "key int, code string, line string")
    items = spark.createDataFrame([(i, "x") for i in (1, 2, 3)], "key int, item string")
    marked = N.add_markers(items, events, "key", "code", ["F1120"], "line", ["ED"])
    assert {r["item"] for r in marked.collect()} == {"x", N.TARGET_ICD_MARKER, N.TARGET_ED_MARKER}
    rules = spark.createDataFrame([(["x"], [N.TARGET_ICD_MARKER], 2.0, 0.1), (["y"], ["x"], 3.0, 0.1)],
                                  "antecedents array<string>, consequents array<string>, lift double, support double")
    split = N.split_rules(rules, {"TARGET_ICD": "TARGET_ICD:", "TARGET_ED": "TARGET_ED:"})
    assert rows(split.select("rule_target")) == [("CONTROL",), ("TARGET_ICD",)]


def test_support_ladder_and_fallback(spark):
    assert N.support_ladder(0.025, 0.01, 0.005) == [0.025, 0.02, 0.015, 0.01]
    tx = N.transactions(baskets(spark, sample_data()), "key")
    rules = N.mine_with_fallback(tx, 0.9, 0.1, 0.2, 30, 0.5)
    best = rules.agg(F.max("support"), F.max("min_support"), F.min("support")).first()
    assert best[1] <= best[2] <= best[0] < best[1] + 0.2


def test_patterns_and_network(spark):
    rules = spark.createDataFrame(
        [(["a"], ["b", "c"], 0.2, 0.5, 1.2, 0.1), (["a"], ["b"], 0.4, 0.7, 1.4, 0.3)],
        "antecedents array<string>, consequents array<string>, support double, confidence double, "
        "lift double, certainty double")
    edges, nodes = N.rule_network(rules)
    got = {(r["source"], r["target"]): r["support"] for r in edges.collect()}
    assert math.isclose(got[("a", "b")], 0.3) and math.isclose(got[("a", "c")], 0.2)
    assert {r["item"]: r["centrality"] for r in nodes.collect()} == {"a": 1.0, "b": 0.5, "c": 0.5}
    patterns = spark.createDataFrame([(1, ["a"], 0.5), (2, ["a", "z"], 0.25)], "slot int, items array<string>, support double")
    tx = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "key int, items array<string>")
    wide = N.expand_patterns(tx, patterns, ["support"], n=3).drop("items")
    assert rows(wide) == [(1, 0.5, 0.0, 0.0), (2, 0.0, 0.0, 0.0)]
    metrics = N.pattern_metrics(patterns, rules).select("slot", "mean_confidence")
    assert rows(metrics) == [(1, 0.6), (2, 0.0)]


def test_rules_of_a_wide_itemset(spark):
    """All subsets of up to two items out of one set of 25: no subset is enumerated by masks."""
    names = [f"i{n:02d}" for n in range(25)]
    data = [([n], 0.5) for n in names] + [([a, b], 0.4) for i, a in enumerate(names) for b in names[i + 1:]] + [(names, 0.3)]
    sets = spark.createDataFrame(data, "items array<string>, support double")
    assert N.association_rules(sets, 0.7).count() == 25 * 24


def test_lift_is_the_same_in_any_partitioning(spark):
    found = N.frequent_itemsets(N.transactions(baskets(spark, sample_data()), "key"), 0.1)
    lifts = [{tuple(r["items"]): r["lift"] for r in N.with_lift(found.repartition(n)).collect()} for n in (1, 3, 7)]
    assert lifts[0] == lifts[1] == lifts[2]


def test_itemsets_of_repeated_and_missing_items(spark):
    """Equal sets count together, an item twice in a transaction counts once, missing ones count in n only."""
    data = [(["b", "a", "a"],), (["a", "b"],), (["c", "a"],), (None,)]
    tx = spark.createDataFrame(data, "items array<string>")
    got = {tuple(r["items"]): (r["frequency"], r["support"]) for r in N.frequent_itemsets(tx, 0.5).collect()}
    assert got == {("a",): (3, 0.75), ("b",): (2, 0.5), ("a", "b"): (2, 0.5)}


def test_patterns_look_for_items_and_build_no_sets(spark):
    patterns = spark.createDataFrame([(1, ["a", "b"], 0.5), (2, [], 0.25)], "slot int, items array<string>, support double")
    tx = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", None]), (3, None)], "key int, items array<string>")
    wide = N.expand_patterns(tx, patterns, ["support"], n=2)
    assert rows(wide.drop("items")) == [(1, 0.5, 0.25), (2, 0.0, 0.25), (3, 0.0, 0.0)]
    assert "array_except" not in wide._jdf.queryExecution().optimizedPlan().toString()
