import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from careloom.operators import evaluation as V
from careloom.operators import gram
from careloom.operators import isotonic


def fitted(pairs):
    """Sequential pooling of (score, label) pairs: value per distinct score."""
    groups = {}
    for s, y in pairs:
        t, w = groups.get(s, (0.0, 0))
        groups[s] = (t + y, w + 1)
    pools = []
    for s in sorted(groups):
        t, w, members = *groups[s], [s]
        while pools and pools[-1][0] * w >= t * pools[-1][1]:
            before = pools.pop()
            t, w, members = t + before[0], w + before[1], before[2] + members
        pools.append((t, w, members))
    return {s: t / w for t, w, members in pools for s in members}


@pytest.mark.parametrize("shape", ["noisy", "falling", "rising", "ties"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_isotonic_equals_sequential_pooling(spark, shape, partitions):
    rnd = random.Random(5)
    pairs = []
    for i in range(900):
        s = rnd.random() if shape != "ties" else round(rnd.random(), 1)
        p = {"noisy": s, "falling": 1 - s, "rising": float(s > 0.4), "ties": s}[shape]
        pairs.append((s, int(rnd.random() < p)))
    df = spark.createDataFrame(pairs, "s double, y int").repartition(5)
    pools = isotonic.isotonic_pools(df, "y", "s", partitions)
    got = {r["s"]: r["v"] for r in isotonic.with_pool_value(df.select("s").distinct(), pools, "s", "v").collect()}
    want = fitted(pairs)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-12) for s in want)


def test_calibration_equals_the_sequential_model_between_scores(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.gauss(i % 2, 1.0), i % 2) for i in range(500)], "s double, y int")
    model = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol="p").fit(df.withColumn("y", F.col("y").cast("double")))
    new = spark.createDataFrame([(x / 7 - 4,) for x in range(60)], "s double")
    pools = isotonic.isotonic_pools(df, "y", "s", 6)
    got = {r["s"]: r["v"] for r in isotonic.with_pool_value(new, pools, "s", "v").collect()}
    for r in model.transform(new).collect():
        assert math.isclose(got[r["s"]], r["p"], abs_tol=1e-9)


def test_calibration_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 0.5, None), (3, 0.5, 1), (4, 0.5, 0), (5, 0.9, 1)], "id int, s double, y int")
    got = {r["id"]: r["calibrated"] for r in V.calibrate(df, "y", "s", ["id"]).collect()}
    assert got == {1: None, 2: 0.5, 3: 0.5, 4: 0.5, 5: 1.0}
    assert V.calibrate(df.limit(0), "y", "s", ["id"]).count() == 0


def test_correlations_leave_nulls_out_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 7)) * 3 + 1e6
    x[:, 1] += 2 * x[:, 0]
    x[:, 2] = 0.1  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3] = np.nan
    names = [f"c{i}" for i in range(7)]
    data = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(6)
    got = {(r[0], r[1]): r[2] for r in V.correlation_matrix(df, names).collect()}
    assert len(got) == 49
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if {i, j} & {2, 3}:
                assert got[a, b] is None
            else:
                assert math.isclose(got[a, b], np.corrcoef(x[both, i], x[both, j])[0, 1], abs_tol=1e-8)


def test_blocks_and_listed_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 23))
    data = [(int(k % 3), [float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(data, "key long, x array<double>").repartition(20)
    whole = {(k, a, b): c for k, a, b, c in gram.correlations(gram.pair_moments(df, 23, block=5), 23, block=5).collect()}
    assert len(whole) == 3 * 23 * 23
    listed = {0: [4], 1: [0, 22], 2: [7, 8, 9]}
    some = {(k, a, b): c for k, a, b, c in gram.correlations(gram.pair_moments(df, 23, listed, 5), 23, listed, 5).collect()}
    assert {(k, a) for k, a, _ in some} == {(k, a) for k, v in listed.items() for a in v} and len(some) == 6 * 23
    for found in (whole, some):
        for (k, a, b), c in found.items():
            assert math.isclose(c, np.corrcoef(x[k::3, a], x[k::3, b])[0, 1], abs_tol=1e-9)


def test_two_thousand_features_in_one_pass(spark):
    rows = spark.range(60).select(F.lit(0).cast("long").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.pmod(F.xxhash64("id", i % 1990), F.lit(997)).cast("double")).alias("x"))
    found = gram.correlations(gram.pair_moments(rows, 2000), 2000)
    same = found.filter("a = 3 and b = 1993").first()["correlation"]  # 1990 features on, the values repeat
    assert math.isclose(same, 1.0, abs_tol=1e-12) and found.count() == 2000 * 2000
