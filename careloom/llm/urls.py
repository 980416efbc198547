"""URL filtering: rules first, and a trained score where no rule fits (operator 7).

Method: logistic regression on hashed character n-grams of host and path, trained from a
small labelled table of URLs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.llm import linear

#: Hashed features, and the n-grams that are hashed.
SIZE, GRAMS = 1 << 16, (2, 3, 4, 5)
#: Labelled URLs that a model is fitted on at most: those with the smallest hashes.
MOST_LABELLED = 4096

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash; null or no ``://``: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, *LETTERS)


def path(url: Column) -> Column:
    """After the host up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and the beginning of a path, such as ``net/``."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of both parts, each marked with the part it comes from."""
    out = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{mark}{part[i: i + n]}".encode()) % SIZE for i in range(len(part) - n + 1))
    return np.fromiter(out, np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts, paths) -> np.ndarray:
        """Probability of block."""
        return linear.sigmoid(np.array([self.weights[f].sum() / np.sqrt(len(f) or 1) for f in map(features, hosts, paths)]) + self.bias)


def fit_urls(labelled: DataFrame, most: int = MOST_LABELLED) -> UrlModel:
    """A model of ``labelled`` (host, path, verdict), at most ``most`` distinct rows of it.

    Rows without a verdict are left out. Without any rows the model blocks nothing; with one
    verdict only it leans to that verdict.
    """
    rows = labelled.filter(F.col("verdict").isNotNull()).select("host", "path", "verdict").distinct()
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(most).toPandas()
    if rows.empty:
        return UrlModel(np.zeros(SIZE, np.float32), -1.0)
    found = [features(h, p) for h, p in zip(rows["host"], rows["path"], strict=True)]
    data = linear.Rows(found, [np.full(len(f), 1 / np.sqrt(len(f) or 1)) for f in found])
    weights, bias = linear.fit(data, (rows["verdict"] == "block").to_numpy(float), SIZE, l2=1e-4)
    return UrlModel(weights.astype(np.float32), bias)


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url: str = "url", bar: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score and verdict to every row.

    ``labelled`` holds url and verdict; where it is not given, the URLs that the rules decide
    are the labelled table. The rules' verdict holds where one fits, else the model blocks from
    a score of ``bar``. A null URL or one without ``://`` has an empty host and path and is
    scored like any other. Columns named like the results are replaced.
    """
    results = ["host", "path", "rule", "score", "verdict"]
    text, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    parts = lambda df, column: df.withColumns({"host": host(F.col(column)), "path": path(F.col(column))})
    named = parts(pages.drop(*results), url).withColumn("rule", text).withColumn("ruled", verdict)
    known = parts(labelled.drop("host", "path"), "url") if labelled is not None else named.withColumnRenamed("ruled", "verdict")
    model = fit_urls(known)

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.scores(hosts, paths))

    scored = named.withColumn("score", score("host", "path"))
    judged = F.coalesce("ruled", F.when(F.col("score") >= bar, "block").otherwise("allow"))
    return scored.withColumn("verdict", judged).drop("ruled")
