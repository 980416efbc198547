import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careloom.functions import warping
from careloom.operators import trajectory as J


def brute(a, b, cost=lambda x, y: float(x != y)):
    if not a or not b:
        return float("inf")
    grid = [[float("inf")] * (len(b) + 1) for _ in range(len(a) + 1)]
    grid[0][0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            grid[i][j] = cost(x, y) + min(grid[i - 1][j], grid[i][j - 1], grid[i - 1][j - 1])
    return grid[-1][-1]


def people(seed=1, n=25, longest=40):
    rnd = random.Random(seed)
    out = {i: [rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))] for i in range(n)}
    out[n] = [rnd.choice("abcdz") for _ in range(longest * 4)]  # one person dominates
    return out


def frame(spark, seqs):
    data = [(p, i + 1, x, int(ord(x))) for p, s in seqs.items() for i, x in enumerate(s)]
    return spark.createDataFrame(data, "person int, position bigint, item string, code int")


def test_distance_properties():
    rnd = random.Random(4)
    for _ in range(60):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(0, 9))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(0, 9))]
        x, y = np.array(a, float), np.array(b, float)
        assert warping.distance(x, y) == brute(a, b) == warping.distance(y, x)
        assert warping.distance(x, y, "abs") == brute(a, b, lambda p, q: abs(p - q))
        if a:
            assert warping.distance(x, x) == 0


@pytest.mark.parametrize("chunk_len", [3, 7, 1000])
@pytest.mark.parametrize("cost,value", [("mismatch", "item"), ("abs", "code")])
def test_chunked_distances_match_brute_force(spark, chunk_len, cost, value):
    seqs = people()
    traj = frame(spark, seqs)
    protos = J.pick_prototypes(traj, 4)
    out = J.dtw_to_prototypes(traj, protos, value, cost, chunk_len=chunk_len)
    got = {(r["person"], r["prototype_id"]): r["distance"] for r in out.collect()}
    chosen = sorted(p for p, s in seqs.items() if s)[:4]
    fn = (lambda x, y: float(x != y)) if cost == "mismatch" else (lambda x, y: abs(ord(x) - ord(y)))
    assert got == {(p, q): brute(s, seqs[q], fn) for p, s in seqs.items() for q in chosen}


def test_listed_pairs(spark):
    seqs = people(2, 8)
    traj = J.sequence_encode(frame(spark, seqs).drop("code"))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (8, 3), (2, 99)], "id_a int, id_b int")
    got = {(r[0], r[1]): r[2] for r in J.dtw_pairs(traj, pairs).collect()}
    assert got == {(0, 1): brute(seqs[0], seqs[1]), (1, 0): brute(seqs[0], seqs[1]),
                   (8, 3): brute(seqs[8], seqs[3]), (2, 99): float("inf")}


@pytest.mark.parametrize("chunk_len", [9, 50])
def test_pairs_in_blocks(spark, chunk_len):
    """Grids of many blocks, among them one with a single column of chunks, and numeric costs."""
    seqs = people(3, 6)
    traj = frame(spark, seqs)
    pairs = spark.createDataFrame([(a, b) for a in seqs for b in seqs if (a + b) % 2] + [(6, 6)], "id_a int, id_b int")
    got = {(r[0], r[1]): r[2] for r in J.dtw_pairs(traj, pairs, "item", chunk_len=chunk_len).collect()}
    assert got == {(a, b): brute(seqs[a], seqs[b]) for a, b in got} and len(got) == pairs.count()
    codes = {(r[0], r[1]): r[2] for r in J.dtw_pairs(traj, pairs, "code", "abs", chunk_len=chunk_len).collect()}
    assert codes == {(a, b): brute(seqs[a], seqs[b], lambda x, y: float(abs(ord(x) - ord(y)))) for a, b in codes}


def test_no_row_holds_a_whole_trajectory(spark):
    chunks, most = J._chunks(frame(spark, people()), "item", 7)
    assert most == 23 and chunks.agg(F.max(F.size("values"))).first()[0] == 7
    assert {r["chunks"] for r in chunks.filter("person = 25").collect()} == {23}


def test_batches_are_cut_by_cells():
    lengths = np.array([5, 1, 9, 3, 3, 20])
    parts = J._by_cells(lengths, 10)
    assert sorted(np.concatenate(parts).tolist()) == list(range(6))
    assert all(len(p) == 1 or len(p) * lengths[p].max() <= 10 for p in parts)


def test_clusters_and_archetypes(spark):
    dist = spark.createDataFrame(
        [(1, 1, 0.0), (1, 2, 4.0), (2, 1, 3.0), (2, 2, 3.0), (3, 1, float("inf")), (3, 2, 1.0)],
        "person int, prototype int, distance double")
    got = {r["person"]: (r["cluster"], r["distance"], r["silhouette"]) for r in J.assign_clusters(dist).collect()}
    assert got[1] == (1, 0.0, 1.0) and got[2] == (1, 3.0, 0.0) and got[3] == (2, 1.0, 0.875)
    clusters = spark.createDataFrame([(i, 1) for i in (5, 6, 7, 8)], "person int, cluster int")
    lengths = spark.createDataFrame([(5, 2), (6, 9), (7, 4), (8, 6)], "person int, length bigint")
    row = J.archetypes(clusters, lengths).first()  # median 5: 7 and 8 are equally close
    assert (row["median_length"], row["archetype"]) == (5, 7)


def test_order_by_days_puts_unknown_last(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (1, "y", 5, 2), (1, "z", 30, 3), (1, "w", 5, 4)],
                               "p int, item string, days_to_target_event int, d int")
    df = df.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    out = J.trajectories(df, "p", "item", "day", mode="days").orderBy("position")
    assert [(r["item"], r["temporal_position"]) for r in out.collect()] == [
        ("z", 30.0), ("y", 5.0), ("w", 5.0), ("x", 0.0)]
