import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import LOW

from careloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, hash binary"


def brute(rows, every=31, least=7):
    counts = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 2 and len(w) >= least}
    near, parts = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            parts[i, w[:i] + w[i + 1:]].add(w)
            if (x := w[:i] + w[i + 1:]) in n:
                near[w].add(x)
                near[x].add(w)
    for group in parts.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def sample(seed=2):
    rng = random.Random(seed)
    letters = "abcdefz" + "àéÿ÷×Ö"
    words = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(40)]
    rows = []
    for i in range(300):
        said = []
        for w in rng.choices(words, weights=[2.0 ** -(k / 3) for k in range(40)], k=60):
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]))
            said.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice((" ", ", ", "1", "—", "Ā")).join(said)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (7, None), (8, ""), (9, "longword" * 3000 + " " + "longword" * 3000), (10, "longword" * 2999 + "longwrd " * 2)]
    rows += [(11 + k, "aaaaaaaa aaaaaaa") for k in range(3)]
    return [(*r, "x", 1, b"k") for r in rows]


@pytest.mark.parametrize("most", [1 << 24, 100])
def test_against_brute_force(spark, most):
    """Also with a vocabulary dealt into parts whose filters are broadcast one after the other."""
    rows = sample()
    got = [tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(4), most_words=most).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in got) > 50 and any(r[2] not in (r[0], r[1]) for r in got)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, "", 1, b"")], SCHEMA)).count() == 0


def test_without_deletions_and_other_bounds(spark):
    rows = [(1, "abc abd abc abcd abcd", "", 1, b"")]
    got = {tuple(r)[:1] + tuple(r)[3:5] for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), every=0, least_length=3).collect()}
    assert got == {("abc", 2, 1), ("abcd", 2, 1)}


def test_edit_hashes_are_those_of_the_edited_words():
    words = ["aabbccd", "éàzzÿab", "a" * 7, "abcdefghij"]
    flat = spelling.Flat.of(words)
    seen = set()
    for hashes, row, place, letter in spelling.edits(flat, 6):
        for h, r, p, c in zip(hashes, row, place, letter, strict=True):
            new = words[r][:p] + (chr(c) if c else "") + words[r][p + 1:]
            one = spelling.Flat.of([new])
            assert spelling.finished(spelling.raw_hashes(one)[2], one.length)[0] == h
            assert (r, new) not in seen
            seen.add((r, new))
    alphabet = list(map(chr, spelling.LETTERS))
    want = {(i, w[:k] + w[k + 1:]) for i, w in enumerate(words) for k in range(len(w))}
    want |= {(i, w[:k] + c + w[k + 1:]) for i, w in enumerate(words) for k in range(len(w)) for c in alphabet if c < w[k]}
    assert seen == want


def test_filters_miss_nothing_and_admit_little(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2)
    length = rng.integers(7, 90, 20000)
    words = spark.createDataFrame([(int(h), int(n)) for h, n in zip(hashes[:10000].view(np.int64), length, strict=False)], "hash long, length long")
    filters = spelling.build_filters(words)
    assert len(filters.maybe(hashes[:10000], length[:10000])) == 10000
    assert len(filters.maybe(hashes[10000:], length[10000:])) < 300


def test_runs_and_checksums():
    texts = pa.array(["Ab×÷é-ZzĀq", "", "x¿y\u0000z"], pa.large_string())
    words = spelling.letter_runs(texts)
    got = [(int(r), words.distinct[int(i)].as_py()) for r, i in zip(words.row, words.index, strict=True)]
    assert got == [(0, "ab×÷é"), (0, "zz"), (0, "q"), (2, "x"), (2, "y"), (2, "z")]
    sums = spelling.Checksums().of(["7", "", "-12"], words)
    assert sums.tolist() == [zlib.crc32(f"{['7', '', '-12'][r]}:{w}".encode()) for r, w in got]
