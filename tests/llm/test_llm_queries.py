"""The registered queries: contracts, SQL twins and the pipeline."""

import os
import sys
import tempfile
from collections import Counter

import pytest
from samples import merge, root_of, shingles

import __spark_entry__ as entry
import corpus_pipeline
from careloom.llm import queries
from test_decontaminate import brute as contaminated

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op2_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_substring_dedup": {"doc_id", "kept_doc_id"},
    "op6_embedding_near_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op7_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_quality": {"doc_id", "quality_score", "keep"},
    "op10_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


def test_registered():
    assert set(COLUMNS) == set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert COLUMNS[name] <= set(df.columns)
    table = {"op1": "pages", "op7": "pages", "op6": "embeddings"}.get(name.split("_")[0], "documents")
    if name not in ("op5_substring_dedup", "op10_best_fit_packing", "op11_spelling_variants", "op13_prefix_trie"):
        assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    from oracle import compare, connect

    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) == "ok"


def near_kept(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs.items()}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    parent = {d: d for d in docs}
    for d, s in sets.items():
        for o, n in Counter(o for x in s for o in by[x] if o < d).items():
            if n * 100 >= percent * (len(s) + len(sets[o]) - n):
                merge(parent, d, o)
    return {d for d in docs if root_of(parent, d) == d}


def test_pipeline_stages(spark):
    folder = tempfile.mkdtemp(prefix="careloom-")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/{i}")
        kept.append({r[0]: r[1] for r in (before if i == 4 else docs).select("doc_id", "text").collect()})
        if i < 4:
            assert docs.columns == columns
    good, single, cut, clean = kept[:4]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    first = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert all(d in good for d in first if labels.get(d) == 1)  # clean documents stay
    assert sum(d in good for d in first if labels.get(d) == 0) <= 0.15 * sum(labels.get(d) == 0 for d in first)
    assert set(single) == near_kept(good)
    assert all(set(cut[d].split()) <= set(single[d].split()) for d in cut)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, _, hit, _ in contaminated(list(cut.items()), items) if not hit}
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(clean)


def test_pipeline_query(spark):
    assert entry.queries()["pipeline"](spark, FOLDER).count() > 0
