"""Document quality without labels (operator 9).

Method: a weak-label model. Overlapping heuristics vote good, bad or not at all on every
document; expectation-maximisation over the counts of all vote patterns estimates how accurate
each heuristic is. The posterior labels of a sample then train a linear scorer on hashed
features, which judges every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from careloom.llm import linear
from careloom.llm.text import CASED, Words, as_texts, slices, split_words, translated
from careloom.llm.tokens import Remembered

#: Hashed features of the scorer.
SIZE = 1 << 14
#: Documents that the scorer is fitted on, about: those whose hash is small.
MOST_SAMPLED = 8000

GOOD, BAD, ABSTAIN = 1, 0, 2

UPPER, LOWER, DIGIT, SYMBOL, OTHER = 0, 1, 2, 3, 4


def byte_kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A] = UPPER, LOWER, DIGIT
    for c in "#$%&*+/<=>@[\\]^_`{|}~!":
        kind[ord(c)] = SYMBOL
    kind[0x80:] = LOWER  # letters outside ASCII, by and large
    return kind


KINDS = byte_kinds()


@dataclass
class Measures:
    """What the heuristics look at, one number per document."""

    words: np.ndarray
    symbols: np.ndarray  # share of bytes
    capitals: np.ndarray  # share of letters
    repeats: np.ndarray  # share of words equal to the one before
    distinct: np.ndarray  # share of words that are new to the document
    short: np.ndarray  # share of up to three bytes among words with a letter or digit
    bars: np.ndarray  # share of words without a letter or digit
    ends: np.ndarray  # share of words that end a sentence
    length: np.ndarray  # mean bytes of a word


def per_row(values: np.ndarray, words: Words) -> np.ndarray:
    return np.bincount(words.row, weights=values, minlength=words.rows)


def measure(texts: pa.Array, words: Words) -> Measures:
    plain = translated(texts, CASED)
    at = np.frombuffer(plain.buffers()[1], np.int64)[: len(texts) + 1]
    data = plain.buffers()[2]
    kinds = KINDS[np.frombuffer(data, np.uint8, count=at[-1])] if data is not None and at[-1] else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    of = lambda kind: np.bincount(row[kinds == kind], minlength=len(texts))
    n = np.maximum(np.bincount(words.row, minlength=words.rows), 1)
    letters = np.maximum(of(UPPER) + of(LOWER), 1)
    size = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False).astype(float)
    full = pc.match_substring_regex(words.distinct, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    ending = pc.match_substring_regex(words.distinct, r"[.!?][\"')]*$").to_numpy(zero_copy_only=False)
    same = np.zeros(len(words.index))
    same[1:] = (words.index[1:] == words.index[:-1]) & (words.row[1:] == words.row[:-1])
    pairs = np.unique(words.row.astype(np.int64) * max(len(size), 1) + words.index) // max(len(size), 1)
    pick = lambda v: per_row(np.asarray(v, float)[words.index], words) / n
    short = pick(full & (size <= 3)) / np.maximum(pick(full), 1e-9)
    return Measures(np.bincount(words.row, minlength=words.rows), of(SYMBOL) / np.maximum(np.diff(at), 1), of(UPPER) / letters,
                    per_row(same, words) / n, np.bincount(pairs, minlength=words.rows) / n, short, pick(~full), pick(ending), pick(size))


def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


def heuristics(m: Measures) -> np.ndarray:
    """One column of votes per heuristic. Texts of a few words get few votes."""
    some, many = m.words >= 5, m.words >= 30
    return np.stack([
        vote(m.symbols > 0.06, m.symbols < 0.02),
        vote(some & (m.capitals > 0.4), m.capitals < 0.15),
        vote(some & (m.repeats > 0.25), m.repeats < 0.05),
        vote(many & (m.distinct < 0.15), many & (m.distinct > 0.3) & (m.words < 2000)),
        vote(many & (m.short < 0.08), many & (m.short > 0.18)),
        vote(some & (m.bars > 0.12), m.bars < 0.02),
        vote(many & ((m.ends > 0.5) | (m.ends < 0.005)), many & (m.ends > 0.02) & (m.ends < 0.35)),
        vote(some & ((m.length > 14) | (m.length < 2)), some & (m.length < 10)),
    ], axis=1)


#: How often a heuristic that votes says bad and good of a bad and of a good document, to begin
#: with. Each knows its own kinds of junk only, so it misses most of the bad documents.
FIRST_GUESS = np.array([[0.3, 0.7], [0.02, 0.98]])
#: The first guess keeps this weight against the documents, so that one kind of junk, on which
#: many heuristics agree, doesn't become the only one.
GUESS_WEIGHT = 0.3


@dataclass
class LabelModel:
    """Share of good documents, and how often each heuristic that votes calls bad and good ones which."""

    prior: float
    rates: np.ndarray  # heuristic x class x vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        evidence = np.log(self.rates[:, GOOD]) - np.log(self.rates[:, BAD])
        evidence = np.pad(evidence, ((0, 0), (0, 1)))  # no vote is no evidence
        score = evidence[np.arange(votes.shape[1]), votes].sum(axis=1)
        return linear.sigmoid(score + np.log(self.prior / (1 - self.prior)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    The first guess also tells it which of the two classes is the good one.
    """
    share = counts / counts.sum()
    model = LabelModel(0.8, np.tile(FIRST_GUESS, (votes.shape[1], 1, 1)))
    for _ in range(steps):
        good = model.posterior(votes) * share
        rates = np.empty_like(model.rates)
        for j in range(votes.shape[1]):
            for y, weight in ((GOOD, good), (BAD, share - good)):
                rates[j, y] = np.bincount(votes[:, j], weights=weight, minlength=3)[:2] + GUESS_WEIGHT * FIRST_GUESS[y]
        prior = (good.sum() + GUESS_WEIGHT * 0.8) / (1 + GUESS_WEIGHT)
        model = LabelModel(float(prior), rates / rates.sum(axis=2, keepdims=True))
    return model


def shape(word: str) -> int:
    """Hash of a word with letters and digits replaced by their kind and runs cut to one."""
    plain = re.sub(r"[^\W\d_]+", lambda x: ("A" if x[0].isupper() else "a") if len(x[0]) == 1 or not x[0][1:].islower() else "Aa" if x[0][0].isupper() else "a", word)
    return zlib.crc32(re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", plain)).encode()) & 0x7FFFFFFF


def length_class(size: np.ndarray) -> np.ndarray:
    """Bytes of a word up to 40, then four classes for every doubling."""
    return np.where(size <= 40, size, 40 + np.ceil(4 * np.log2(np.maximum(size, 40) / 40)).astype(np.int64))


def features(words: Words, known: Remembered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and share of the row's words: shapes, pairs of shapes, repeats, lengths."""
    distinct = words.distinct.to_pylist()
    shapes = np.array(known(distinct), dtype=np.int64)[words.index] if distinct else np.zeros(0, np.int64)
    size = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False)[words.index] if distinct else shapes
    follows = words.row[1:] == words.row[:-1]
    pair = (shapes[:-1] * 31 + shapes[1:] + 1)[follows]
    same = (words.index[1:] == words.index[:-1])[follows]
    row = np.concatenate([words.row, words.row[1:][follows], words.row[1:][follows][same], words.row])
    feature = np.concatenate([shapes % SIZE, pair % SIZE, np.full(int(same.sum()), 7), 100 + length_class(size)])
    n = np.maximum(np.bincount(words.row, minlength=words.rows), 1)
    both, count = np.unique(row.astype(np.int64) * SIZE + feature, return_counts=True)
    return both // SIZE, both % SIZE, count / n[both // SIZE]


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, known: Remembered) -> np.ndarray:
        """Probability of good; texts without words get the share of good documents."""
        words = split_words(texts, CASED)
        row, feature, value = features(words, known)
        out = linear.sigmoid(np.bincount(row, weights=self.weights[feature] * value, minlength=len(texts)) + self.bias)
        out[np.diff(words.bounds) == 0] = self.labels.prior
        return out


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sampled: int = MOST_SAMPLED) -> QualityModel:
    """Label model over the vote patterns of all documents, scorer over ``sampled`` of them at most.

    The sample is that of the smallest hashes of id and text. Rows that repeat both are one row of it that
    weighs as much as all. Null texts count as empty ones. Without documents the model calls everything good.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(1 << 30)).alias("h"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = as_texts(batch.column(0))
                votes = heuristics(measure(texts, split_words(texts, CASED)))
                codes, counts = np.unique(votes @ (3 ** np.arange(votes.shape[1])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    # at most 3 ** heuristics rows, however many documents there are
    found = rows.mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    if not found:
        return QualityModel(LabelModel(0.8, np.tile(FIRST_GUESS, (8, 1, 1))), np.zeros(SIZE), 20.0)
    width = heuristics(measure(pa.array([""], pa.large_string()), split_words(pa.array([""], pa.large_string()), CASED))).shape[1]
    codes, counts = np.array([r["code"] for r in found]), np.array([r["n"] for r in found], dtype=float)
    labels = fit_labels(codes[:, None] // 3 ** np.arange(width) % 3, counts)
    cut = int(min(1.0, sampled / counts.sum()) * (1 << 30))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda words: [shape(w) for w in words])
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = as_texts(batch.column(0))
                words = split_words(texts, CASED)
                good = labels.posterior(heuristics(measure(texts, words)))
                row, feature, value = features(words, known)
                at = pa.array(np.searchsorted(row, np.arange(words.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(good), *lists], names=["h", "n", "good", "features", "shares"])

    # a combining aggregate: of a row that fills a third of the table each task hands on one
    drawn = rows.filter(F.col("h") < cut).groupBy("text", "h").agg(F.count(F.lit(1)).alias("n")).orderBy("h", F.md5("text")).limit(sampled)
    data = drawn.mapInArrow(sample, "h long, n long, good double, features array<int>, shares array<double>").toPandas().sort_values("h", kind="stable")
    if data.empty:
        return QualityModel(labels, np.zeros(SIZE), 20.0 if labels.prior >= 0.5 else -20.0)
    train = linear.Rows([np.asarray(x, np.int64) for x in data["features"]], [np.asarray(x) for x in data["shares"]])
    weights, bias = linear.fit(train, data["good"].to_numpy(), SIZE, data["n"].to_numpy(float), l2=1e-5, steps=400)
    return QualityModel(labels, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "quality_score", keep: str = "keep", bar: float = 0.5) -> DataFrame:
    """Adds the probability that a document is good, and whether it stays.

    Null and empty texts get the share of good documents. Rows and further columns pass
    through; columns named like the results are replaced.
    """
    kept = docs.drop(score, keep)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType()), StructField(keep, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda words: [shape(w) for w in words])
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                found = model.scores(as_texts(batch.column(at)), known)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(found >= bar)], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)
