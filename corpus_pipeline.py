"""Raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept: low-quality documents go, one document
of each near-duplicate group stays, repeated passages are cut out, documents that hold benchmark
passages go, and what is left is packed into sequences of 2048 tokens.

No stage fails on an empty table, which gives an empty one of the same columns, or on columns named
like its own: all but the last return the columns of their input with the values that those had.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from careloom.llm import decontaminate, neardup, packing, quality, substrings, tokens
from careloom.session import shared_folder, tune

#: Tokens of a sequence.
CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good, every row by itself.

    Rows of the same text, with or without an id, stay or go together. Null and empty texts, and those
    without words, get the share of good documents as their score: they stay while most documents are good.
    """
    tune(spark)
    scored = quality.score_quality(docs, quality.fit_quality(docs), score="__quality", keep="__good")
    return scored.filter("__good").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles agree by 80 in 100: the one with the smallest id.

    Rows that repeat id and text stay once. Texts without words, null ones included, are like no other and
    stay. Of rows that share an id but not the text each is judged by itself; a row without an id stays
    unless it repeats another one without an id.
    """
    tune(spark)
    return neardup.drop_near_duplicates(docs, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document with a smaller id holds.

    A document that loses all its words goes; one that loses none, null and empty texts included, stays as it is.
    Rows without an id, and those that share one but not the text, come after all others in the order of id and text.
    """
    tune(spark)
    return substrings.remove_spans(docs, substrings.repeated_spans(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, every row judged by its own text, whatever its id.

    Null and empty texts hold none and stay; without benchmark items all documents stay.
    """
    tune(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the offset each is packed at.

    A null or empty text is the one token that ends a document. Repeated rows and rows without an id are
    packed like others; columns besides id and text are not read.
    """
    tune(spark)
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't train the classifier or apply the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
