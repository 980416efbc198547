import numpy as np
import pytest
from samples import merge, root_of

from careloom.llm import embeddings


def vectors(dims=16, n=150, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):  # near copies of one vector, on both sides of the threshold
        rows.append((n + i, (base[3] + rng.standard_normal(dims) * np.linalg.norm(base[3]) * rng.choice([0.02, 0.08, 0.12]) / 1.5).tolist()))
    rows += [(n + 60 + i, base[9].tolist()) for i in range(5)]
    rows.append((n + 65, (base[9] * 7).tolist()))
    last = n + 66
    rows += [(last, None), (last + 1, []), (last + 2, [0.0] * dims), (last + 3, [float("nan")] + [1.0] * (dims - 1)), (last + 4, [None] + [1.0] * (dims - 1)),
             (last + 5, [float("inf")] * dims), (None, base[9].tolist()), (2, base[2].tolist()), (last + 6, [1.0] * (dims + 1)), (last + 7, (base[9] * 1e-200).tolist())]
    return rows


def brute(rows, cosine):
    units = []
    for _, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0
        x = np.array(v) / np.abs(v).max() if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    parent, n = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= cosine:
                n[i] += 1
                n[j] += 1
                merge(parent, i, j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root_of(parent, i)] = min(least.get(root_of(parent, i), v), v)
    return sorted(((v, n[i], least.get(root_of(parent, i))) for i, (v, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("dims", "block"), [(16, 192), (3, 20), (64, 20)])
def test_against_brute_force(spark, dims, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(dims)
    df = spark.createDataFrame([(*r, "x", b"k") for r in rows], "vec_id long, embedding array<double>, direction string, key binary")
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute(rows, 0.95)


def test_recall_at_the_threshold():
    code = embeddings.code_for(64, 100_000, 0.95)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((200, 64))
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    common = [len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y), strict=True)]
    assert np.mean(np.array(common) > 0) >= 0.99
    unrelated = [len(np.intersect1d(a, b)) for a, b in zip(code.decode(x[:100]), code.decode(x[100:]), strict=True)]
    assert sum(unrelated) <= 2


def test_decoded_directions_are_those_above_the_height():
    code = embeddings.Code(6, 5, 0.4)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(6)
    x /= np.linalg.norm(x)
    wanted = []
    for c, (rotation, books) in enumerate(embeddings.code_parts(code)):
        turned = x @ rotation
        for i in range(5):
            for j in range(5):
                if (turned[:3] @ books[0][i] + turned[3:] @ books[1][j]) / np.sqrt(2) >= 0.4:
                    wanted.append(c * 25 + i * 5 + j)
    assert code.decode(x[None, :])[0].tolist() == wanted


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
