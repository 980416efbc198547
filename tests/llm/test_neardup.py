import numpy as np
import pytest
from samples import merge, root_of, shingles

from careloom.llm import banding, graph, neardup


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both * 100 >= percent * len(a | sets[j]):
                merge(parent, i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = root_of(parent, i)
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root_of(parent, i))) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("percent", "block"), [(80, 96), (85, 4)])
def test_against_brute_force(docs, rows, percent, block, monkeypatch):
    monkeypatch.setattr(banding, "BLOCK_SETS", block)
    got = neardup.near_duplicates(docs, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, percent)


def test_one_document_of_each_group_stays(docs, rows):
    kept = neardup.drop_near_duplicates(docs)
    wanted = {doc for doc, _, least in brute(rows, 80) if doc == least and doc is not None}
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == wanted
    assert len([i for i in ids if i is not None]) == len(wanted)  # the repeated row is there once
    assert ids.count(None) == 2


def test_rows_of_one_id_are_judged_each_by_itself(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, one), (2, one), (2, other), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, neardup.drop_near_duplicates(df).collect()))) == sorted(map(repr, [(1, one), (2, other), (None, "x y")]))


def test_no_row_per_pair_of_copies(spark):
    df = spark.createDataFrame([(i, "the same few words in every one of these rows") for i in range(3000)], "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 3000


def test_empty_table(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (7, None)] + [(600, i) for i in range(601, 900)]
    parent = list(range(1000))
    for a, b in edges:
        if b is not None:
            merge(parent, a, b)
    nodes = {x for e in edges if e[1] is not None for x in e}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(x, root_of(parent, x)) for x in nodes} and len(got) == len(nodes)


def test_signature_values_agree_like_the_sets():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    keys = banding.band_keys(np.concatenate([a, b]), np.array([0, 1000]), 400, 1)
    assert abs((keys[0] == keys[1]).mean() - 800 / 1200) < 0.1


def test_intersections_match_sets(monkeypatch):
    monkeypatch.setattr(banding, "MATRIX_COLUMNS", 16)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 120, n)).astype(np.uint64) for n in (1, 30, 60, 90, 5)]
    got = banding.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))
