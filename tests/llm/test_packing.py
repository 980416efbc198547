import os
import zlib

import numpy as np
import pytest

from careloom.llm import packing, tokens

PATH = tokens.tokenizer_path("word_bpe_49k.json")


def expected(rows, capacity):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out += [(doc, p, a, len(ids[a: a + capacity]), zlib.crc32(ids[a: a + capacity].tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def filled(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize(("group", "waste"), [(16, 0.1), (8192, 0)])
def test_pieces_and_sequences(docs, rows, group, waste, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", group)
    got = packing.pack_documents(docs, PATH, 256).collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == expected(rows, 256)
    sequences = filled(got, 256)
    at_once = packing.best_fit(np.array([r["length"] for r in got]), 256)[0].max() + 1
    assert sequences <= at_once * (1 + waste)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 4, 1]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 9]


def test_items_that_all_fill_more_than_half(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 8)
    items = spark.createDataFrame([(i, 60, "x") for i in range(50)], "doc_id long, length long, fill string").drop("fill")
    got = packing.pack(items, 100).collect()
    assert filled(got, 100) == 50


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, PATH, 64).count() == 0
