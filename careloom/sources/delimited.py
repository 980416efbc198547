"""Delimited claim text: reading, separator sniffing and repair of ragged lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIPE = "|"
CP1252 = "windows-1252"
# A control character that claim text never holds: makes the CSV reader return whole lines.
_NO_SEPARATOR = "\u0001"


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark 4 reads only a short list of charsets unless told to accept all of Java's."""
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
    sep: str = PIPE, encoding: str = CP1252,
) -> DataFrame:
    """Text with a header as an all-string table; the files stay splittable."""
    _allow_charset(spark, encoding)
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, quote="",
                                mode="PERMISSIVE", enforceSchema=True)
    if columns is not None:
        reader = reader.schema(string_schema(columns))
    return reader.csv(path)


def read_lines(
    spark: SparkSession, path: str | list[str], encoding: str = CP1252, header: bool = False
) -> DataFrame:
    """Raw lines in the column ``value``, decoded from any single-byte encoding.

    ``header`` leaves out the first line of each file.
    """
    _allow_charset(spark, encoding)
    lines = spark.read.options(sep=_NO_SEPARATOR, encoding=encoding, quote="", header=header,
                               enforceSchema=True)
    return lines.schema("value string").csv(path).filter(F.length("value") > 0)


def read_repaired(
    spark: SparkSession, path: str | list[str], header: Sequence[str], tail_numeric: int,
    sep: str = PIPE, encoding: str = CP1252,
) -> tuple[DataFrame, DataFrame]:
    """Raw text files as a table of the header's columns, and the lines that can't be repaired.

    Each file's header line is left out; every other line is fixed, padded, spilled or a reject,
    so no field of an over-long line is lost. The table keeps ``repair_status``.
    """
    rows = repair_ragged_rows(read_lines(spark, path, encoding, header=True), header,
                              tail_numeric, sep, keep_line=True)
    unfit = F.col("repair_status") == "unfixable"
    return rows.filter(~unfit).drop("value"), rows.filter(unfit).select("value")


def sniff_separator(lines: DataFrame, candidates: Sequence[str] = (PIPE, "\t")) -> str:
    """Separator that occurs most often in the first non-blank line (the first one on a tie)."""
    row = lines.filter(F.trim("value") != "").limit(1).collect()
    text = row[0]["value"] if row else ""
    return max(candidates, key=text.count)


def read_delimited_auto(
    spark: SparkSession, path: str, encoding: str = CP1252,
    candidates: Sequence[str] = (PIPE, "\t"),
) -> DataFrame:
    """Reads text whose separator is not known; one line is looked at on the driver.

    All columns stay strings, so no type guess can fail, and a single-byte encoding decodes any
    input: no second attempt is needed.
    """
    sep = sniff_separator(read_lines(spark, path, encoding), candidates)
    return read_delimited(spark, path, None, sep, encoding)


def _fields(sep: str):
    return F.split("value", f"\\Q{sep}\\E", -1)


def write_delimited(
    df: DataFrame, path: str, sep: str = PIPE, encoding: str = CP1252
) -> None:
    """Delimited text with a header, unquoted."""
    _allow_charset(df.sparkSession, encoding)
    df.write.options(header=True, sep=sep, encoding=encoding, quote="").csv(path)


def split_good_bad(
    lines: DataFrame, n_fields: int, sep: str = PIPE
) -> tuple[DataFrame, DataFrame]:
    """Lines with the header's number of fields, and the rest (whole lines)."""
    good = F.size(_fields(sep)) == n_fields
    return lines.filter(good), lines.filter(~good)


def repair_ragged_rows(
    lines: DataFrame, header: Sequence[str], tail_numeric: int, sep: str = PIPE,
    keep_line: bool = False,
) -> DataFrame:
    """Columns of the header plus ``repair_status`` for every line.

    Exact lines are 'fixed'. Short lines are padded with '' on the right ('padded'). Long lines
    keep their last ``tail_numeric`` fields on the right; the surplus in the middle is joined again
    into the last header column before the tail whose name holds 'desc' or 'name' ('spilled').
    """
    header = list(header)
    n, head_n = len(header), len(header) - tail_numeric
    named = [i for i in range(head_n) if any(w in header[i].lower() for w in ("desc", "name"))]
    spill = named[-1] if named else head_n - 1
    right_n = head_n - spill - 1
    rows = lines.select("value", _fields(sep).alias("f")).withColumn("m", F.size("f"))
    surplus = F.col("m") - n
    padded = F.concat("f", F.array_repeat(F.lit(""), F.greatest(-surplus, F.lit(0))))
    middle = F.array_join(F.slice("f", spill + 1, F.greatest(surplus, F.lit(0)) + 1), sep)
    after = F.slice("f", F.lit(spill + 2) + F.greatest(surplus, F.lit(0)),
                    F.lit(right_n + tail_numeric))
    spilled = F.concat(F.slice("f", 1, spill), F.array(middle), after)
    status = (
        F.when(F.col("m") == n, "fixed")
        .when(F.col("m") < n, "padded")
        .when(F.lit(head_n > 0), "spilled")
        .otherwise("unfixable")
    )
    fixed = F.when(F.col("m") <= n, padded).otherwise(spilled)
    line = ["value"] if keep_line else []
    return rows.select(status.alias("repair_status"), fixed.alias("f"), *line).select(
        *[F.try_element_at("f", F.lit(i + 1)).alias(c) for i, c in enumerate(header)],
        "repair_status", *line,
    )


def repair_counts(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("repair_status").agg(F.count(F.lit(1)).alias("n"))
