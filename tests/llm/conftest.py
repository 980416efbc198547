import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import corpus  # noqa: E402

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def rows():
    return corpus()[0]


@pytest.fixture(scope="session")
def passage():
    return corpus()[1]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The sample as a written table, over several files, with columns that clash with results."""
    path = str(tmp_path_factory.mktemp("docs"))
    data = [(*r, "x", 1, b"k", [0]) for r in rows]
    schema = DOCS + ", h string, n_tokens int, key binary, bands array<int>"
    spark.createDataFrame(data, schema).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
