import random

import numpy as np
import pyarrow as pa
import xxhash
from samples import prose

from careloom.llm import banding, text
from careloom.llm.decontaminate import least_grams
from careloom.llm.neardup import shingle_sets


def words_of_all_lengths():
    rng = random.Random(3)
    alphabet = "aAb\x00é漢🙂"
    return sorted({"".join(rng.choices(alphabet, k=n)) for n in range(1, 90) for _ in range(20)})


def test_usual_words_are_hashed_together(monkeypatch):
    asked = []
    real = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(text.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or real(w))
    words = text.split_words(pa.array([prose(random.Random(5), 3000)], pa.large_string()), text.SPACED)
    assert len(np.unique(words.hashes())) == len(words.distinct) and not asked


def test_a_words_hash_is_of_its_bytes_alone():
    words = words_of_all_lengths()
    got = dict(zip(words, text.word_hashes(pa.array(words, pa.large_string())).tolist(), strict=True))
    assert len(set(got.values())) == len(words)
    again = words[:]
    random.Random(4).shuffle(again)
    for column in (pa.array(again, pa.large_string()), pa.array(["x", *again], pa.string()).slice(1), pa.array(["漢" * 40, *again], pa.large_string()).slice(1)):
        assert text.word_hashes(column).tolist() == [got[w] for w in again]
    assert text.word_hashes(pa.array([], pa.large_string())).tolist() == []
    assert len(text.word_hashes(pa.array([""], pa.large_string()))) == 1


def test_least_grams_by_hand():
    rng = np.random.default_rng(7)
    for n in (0, 3, 22, 23, 24, 300):
        hashes = rng.integers(0, 4, n, dtype=np.uint64)  # many equal ones: the first counts
        for span, k in ((23, 4), (10, 5), (4, 4), (5, 1)):
            at, grams = least_grams(hashes, span, k)
            width = span - k + 1
            assert at.tolist() == [i + int(np.argmin(grams[i: i + width])) for i in range(len(grams) - width + 1)]


def test_shingle_sets_by_hand():
    rng = random.Random(13)
    rows = ["", *(" ".join(rng.choices("abc", k=k)) for k in (1, 2, 3, 4, 5, 6, 40, 0, 400, 4, 9))]
    row, value = shingle_sets(text.split_words(pa.array(rows, pa.large_string()), text.SPACED))
    for r, t in enumerate(rows):
        w = t.split()
        own = value[row == r]
        assert len(own) == (len({tuple(w[i: i + 5]) for i in range(len(w) - 4)}) if len(w) > 4 else min(len(w), 1))
        assert (np.diff(own.astype(object)) > 0).all()
    assert (np.diff(row) >= 0).all()


def test_rare_hashes_make_no_matrix(monkeypatch):
    monkeypatch.setattr(banding.np, "zeros", lambda shape, dtype=float, real=np.zeros: real(shape, dtype) if dtype is not np.float32 else 1 / 0)
    sets = [np.arange(i, i + 10, dtype=np.uint64) for i in range(30)]
    got = banding.shared_counts(sets)
    assert all(got[i, j] == max(10 - abs(i - j), 0) for i in range(30) for j in range(30) if i != j)


def test_rare_and_frequent_hashes_are_counted_alike(monkeypatch):
    monkeypatch.setattr(banding, "MATRIX_COLUMNS", 16)
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([rng.integers(0, 60, n), rng.integers(100, 1000, 80)])).astype(np.uint64) for n in range(1, 60)]
    got = banding.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
