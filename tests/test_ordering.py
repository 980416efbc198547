import random

from pyspark.sql import functions as F

from careloom.operators import ordering as O


def data(spark, n=3000):
    rnd = random.Random(5)
    # Key 0 holds a third of all rows.
    rows = [(0 if rnd.random() < 0.34 else rnd.randrange(1, 40), rnd.randrange(400), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, t int, id int")


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_positions_match_brute_force(spark):
    rows, df = data(spark)
    out = O.with_position(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 7), "p")
    expected = {(r[0], r[2]): i + 1 for g in by_key(rows).values() for i, r in enumerate(g)}
    assert {(r["k"], r["id"]): r["p"] for r in out.collect()} == expected


def test_hot_key_is_spread(spark):
    _, df = data(spark)
    counts = df.groupBy("k", F.floor(F.col("t") / 7)).count().agg(F.max("count")).first()[0]
    total = df.filter("k = 0").count()
    assert counts < total / 20


def test_neighbours_match_brute_force(spark):
    rows, df = data(spark)
    bucket = F.floor(F.col("t") / 11)
    nxt = O.with_neighbour(df, ["k"], ["t", "id"], bucket, "id", "n", 1)
    prv = O.with_neighbour(df, ["k"], ["t", "id"], bucket, "id", "n", -1)
    expect_next, expect_prev = {}, {}
    for g in by_key(rows).values():
        ids = [r[2] for r in g]
        expect_next |= dict(zip(ids, ids[1:] + [None]))
        expect_prev |= dict(zip(ids, [None] + ids[:-1]))
    assert {r["id"]: r["n"] for r in nxt.collect()} == expect_next
    assert {r["id"]: r["n"] for r in prv.collect()} == expect_prev


def test_running_totals(spark):
    rows, df = data(spark)
    out = O.with_running_total(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 13), {"s": "t"})
    expected = {}
    for g in by_key(rows).values():
        total = 0
        for r in g:
            total += r[1]
            expected[r[2]] = total
    assert {r["id"]: r["s"] for r in out.collect()} == expected


def test_sample_is_reproducible_and_exact(spark):
    _, df = data(spark)
    first = {r["k"] for r in O.sample_keys(df, "k", 10, 7).collect()}
    again = {r["k"] for r in O.sample_keys(df.repartition(5), "k", 10, 7).collect()}
    other = {r["k"] for r in O.sample_keys(df, "k", 10, 8).collect()}
    assert len(first) == 10 and first == again and first != other


def test_first_per_key(spark):
    rows, df = data(spark)
    got = {tuple(r) for r in O.first_per_key(df, ["k"], ["t", "id"]).collect()}
    assert got == {g[0] for g in by_key(rows).values()}


def odd_rows(spark):
    """Null keys, null times and one key with nine tenths of the rows on one day."""
    rows = [(None, None, 0), (None, 3, 1), (1, None, 2), (1, None, 3), (1, 5, 4)]
    rows += [(9, 7, i) for i in range(5, 1000)] + [(i, i % 5, i) for i in range(1000, 1100)]
    return rows, spark.createDataFrame(rows, "k int, t int, id int")


def nulls_first(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def buckets():
    return [F.floor(F.col("t") / 2), None]


def test_null_keys_and_times_keep_their_rows(spark):
    rows, df = odd_rows(spark)
    expected = {r[2]: i + 1 for g in nulls_first(rows).values() for i, r in enumerate(g)}
    following = {r[2]: n for g in nulls_first(rows).values() for r, n in zip(g, [x[2] for x in g[1:]] + [None])}
    for bucket in buckets():
        out = O.with_position(df, ["k"], [F.col("t"), F.col("id")], bucket, "p").collect()
        assert len(out) == len(rows) and {r["id"]: r["p"] for r in out} == expected
        out = O.with_neighbour(df, ["k"], ["t", "id"], bucket, "id", "n").collect()
        assert len(out) == len(rows) and {r["id"]: r["n"] for r in out} == following
        out = O.with_running_total(df, ["k"], [F.col("t"), F.col("id")], bucket, {"s": "id"})
        assert out.count() == len(rows)


def test_hot_day_is_spread_by_range(spark):
    _, df = odd_rows(spark)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # a few kilobytes would be merged into one task
    try:
        cut = O.with_bucket(df.repartition(8), ["k"], [F.col("t"), F.col("id")], None)
    finally:
        spark.conf.set(merge, "true")
    sizes = [r["count"] for r in cut.groupBy("k", "__bucket").count().collect()]
    assert max(sizes) <= 1100 / 4  # 995 rows of one key and day lie in many partitions
