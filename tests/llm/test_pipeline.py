"""Every stage of the pipeline on odd rows: no ids, repeats, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
CLASHING = {"keep": "mine", "quality_score": "q", "id": "i", "row_no": "r", "spans": "s", "component_id": "c", "text_key": "k", "n_words": "w"}


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """Every row of the sample twice, over 3 files, under names that the stages use themselves."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs.unionByName(docs).withColumns({c: F.lit(v) for c, v in CLASHING.items()}).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_odd_rows(spark, odd, tmp_path):
    docs, seen = odd, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, FOLDER)
        assert out.columns == odd.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        left = docs.collect()
        assert all(r[c] == v for r in left for c, v in CLASHING.items())
        seen.append(left)
        if i != 2:  # only the substring stage changes a text
            assert set(rows_of(docs)) <= set(rows_of(before))
    good, single, cut, clean = seen
    without = [r for r in good if not (r["text"] or "").strip()]
    assert len(without) in (0, 8)  # null, blank and empty texts, one of them without an id, twice: all or none
    assert len({(r["doc_id"], r["text"]) for r in single}) == len(single)
    assert sum(r["doc_id"] is None for r in single) == len({r["text"] for r in good if r["doc_id"] is None})
    assert {r["doc_id"] for r in cut if not r["text"]} == {r["doc_id"] for r in single if not r["text"]}
    assert rows_of(spark.createDataFrame(cut, odd.schema)) == rows_of(spark.createDataFrame(clean, odd.schema))  # no benchmark passage in them
    pieces = corpus_pipeline.packing_stage(spark, docs, FOLDER).collect()
    assert sorted(str(p["doc_id"]) for p in pieces if p["piece"] == 0) == sorted(str(r["doc_id"]) for r in clean)
    assert all(p["length"] == 1 for p in pieces if p["doc_id"] in {r["doc_id"] for r in clean if not r["text"] and r["doc_id"] is not None})


@pytest.mark.parametrize("number", range(5))
def test_empty_table(spark, no_docs, number):
    docs = no_docs.withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    out = corpus_pipeline.STAGES[number][1](spark, docs, FOLDER)
    assert out.count() == 0
    assert number == 4 or out.columns == docs.columns
