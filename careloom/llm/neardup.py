"""Near-duplicate documents by min-max hashing (operator 4).

Method: every permutation gives its minimum and its maximum over a document's word shingles,
which halves the hash evaluations of a signature; the signature is banded, documents that
share a band collide, and collisions are confirmed on whole shingle sets. Documents with equal
sets are one class from the start, so copies cost nothing further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from careloom.llm.banding import band_keys, blocked, clusters, digests, linked_components, numbered
from careloom.llm.bits import bitmap, maybe_in, parted
from careloom.llm.text import SPACED, Words, as_texts, gram_hashes, mixed, slices, split_words
from careloom.session import cut_lineage

#: Words of a shingle.
SHINGLE = 5
#: 28 bands of 5 values, from 70 permutations: a pair of similarity 0.8 is missed once in
#: 70,000 cases, one of 0.85 once in ten million.
BANDS, ROWS = 28, 5


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted; a row of fewer words has them all as one."""
    hashes, row, bounds = words.hashes(), words.row, words.bounds
    grams = gram_hashes(hashes, n)
    inside = row[: len(grams)] == row[n - 1:] if len(grams) else np.zeros(0, bool)
    rows, values = [row[: len(grams)][inside]], [grams[inside]]
    starts = np.searchsorted(rows[0], np.arange(words.rows + 1))
    for r in np.flatnonzero(np.diff(starts) > 1):
        values[0][starts[r]: starts[r + 1]].sort()
    length = np.diff(bounds)
    for few in range(1, n):
        for r in np.flatnonzero(length == few):
            rows.append(np.array([r], np.int32))
            with np.errstate(over="ignore"):
                values.append(mixed(gram_hashes(hashes[bounds[r]: bounds[r + 1]], few) + np.uint64(few)))
    row, value = np.concatenate(rows), np.concatenate(values)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(docs: DataFrame, id_col: str, text: str, bands: int, rows: int) -> DataFrame:
    """``id``, ``size`` of the shingle set, its digest as ``key`` and its band keys; no key if it is empty."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    schema = StructType([source.schema["id"], StructField("size", LongType()), StructField("key", BinaryType()), StructField("bands", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, value = shingle_sets(split_words(as_texts(batch.column(1)), SPACED))
                size = np.bincount(row, minlength=len(batch))
                full = np.flatnonzero(size)
                key, keys = [None] * len(batch), [None] * len(batch)
                if len(full):
                    starts = np.searchsorted(row, full)
                    for r, d, b in zip(full.tolist(), digests(value, starts), band_keys(value, starts, bands, rows).view(np.int64), strict=True):
                        key[r], keys[r] = d, b
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return source.mapInArrow(run, schema)


def sets_of(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """Shingle sets, as ``key`` and ``set``, of the documents whose ids ``wanted`` names and some more."""
    bits = bitmap(wanted, F.xxhash64("id"))
    source = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(maybe_in(bits, whole.column(0).to_numpy())))
            for batch in slices(whole, "text"):
                row, value = shingle_sets(split_words(as_texts(batch.column(1)), SPACED))
                if not len(row):
                    continue
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                sets = [v.astype("<u8").tobytes() for v in np.split(value, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(digests(value, starts), pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    return source.mapInArrow(run, "key binary, set binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For every row of ``docs``: id, n_shingles, component_id and the shingle set's digest as ``key``.

    Rows are linked where their sets' Jaccard similarity is ``percent`` in 100 or more; the
    component is named by the smallest id in it. A null or empty text has no shingles, is
    linked with nothing and names its own component. Repeated rows are linked with each other.
    A row without id can be in a component, whose name is that of its other rows, or null
    if it has none. Further columns are not read; an empty table gives an empty one.
    """
    signed = cut_lineage(signatures(docs, id_col, text, bands, rows))
    classes = numbered(signed.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.first("bands").alias("bands")))
    members = cut_lineage(blocked(classes.drop("bands").join(clusters(classes), "no")))
    # a class without an id can't be looked up by it; those few are looked up by null
    sets = sets_of(docs, id_col, text, members).dropDuplicates(["key"])
    roots = linked_components(members.join(sets, "key"), percent)
    named = classes.select("key", "id", "no").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "root").select("key", "component_id")
    out = signed.drop("bands").join(of_class, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, then the smallest digest of the text.

    Rows that repeat id and text stay once, also without an id. Every other row without an id
    stays, as nothing names it. Rows of one id but of different texts are judged each by itself.
    """
    source = F.col(id_col)
    rows = docs.withColumn("__row", F.struct(source.isNull().alias("none"), source.alias("id"), F.md5(F.col(text).cast("string")).alias("text")))
    found = near_duplicates(rows, "__row", text, percent).select("__row", "component_id")
    goes = ~F.col("__row.none") & (F.col("component_id") < F.col("__row"))
    marks = found.groupBy("__row").agg(F.max(goes).alias("__goes"), F.count(F.lit(1)).alias("__n"))
    marks = cut_lineage(marks.filter("__goes or __n > 1").withColumnRenamed("__row", "__marked"))
    whole, maybe = parted(rows, F.col("__row"), marks, "__marked")
    joined = maybe.join(marks, F.col("__row") == F.col("__marked"), "left").filter("not coalesce(__goes, false)")
    repeated = F.coalesce(F.col("__n") > 1, F.lit(False))
    once = joined.filter(~repeated).select(*docs.columns)
    several = joined.filter(repeated).select(*docs.columns).dropDuplicates([id_col, text])
    return whole.select(*docs.columns).unionByName(once).unionByName(several)
