"""Session helpers: the settings every job relies on, and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive features the operators rely on.

    Joins carry no broadcast hints: adaptive execution measures each shuffled side and
    broadcasts it only under ``autoBroadcastJoinThreshold``. Hot join keys are split by the
    adaptive skew join, also where the split costs one more shuffle.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # bytes of a shuffle are compressed rows, which a join, several rows per slot and a map of groups make many times larger
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, "16m")
    # a batch for Python is held twice over by the task and its worker
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def build_session(app: str = "careloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder named by the cluster; a scratch folder only for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="careloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _bytes(text: str) -> int:
    """Number of bytes of a setting such as 10485760b, 256k or -1."""
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    digits = text.strip().lower().rstrip("b")
    return int(digits[:-1]) << units[digits[-1]] if digits and digits[-1] in units else int(digits)


def code_list(codes: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct texts of a one-column table, checkpointed and measured: is it under the broadcast threshold?

    A join that plans by estimates shuffles its large side before adaptive execution learns that the list is
    small; measured first, a small list is marked for broadcast and a large one is left to the shuffle.
    """
    listed = cut_lineage(codes.distinct())
    size = listed.agg(F.sum(F.coalesce(F.octet_length(F.col(codes.columns[0]).cast("string")), F.lit(0)) + 32)).first()[0] or 0
    small = size <= _bytes(codes.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return (F.broadcast(listed) if small else listed), small


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read the written rows, also after an executor is lost."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
