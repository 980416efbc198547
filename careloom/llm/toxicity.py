"""Toxicity scores that don't hang on which group a text mentions (operator 8).

Method: a counterfactual-regularised linear classifier. In labelled texts every identity term
is swapped for the others of its set; the mean square of the score changes that the swaps
cause is added to the logistic loss. Group mentions then carry no weight of their own, and a
neutral sentence about a group isn't scored as toxic for it.

Features are the distinct words of a text and the first four to six characters of longer words, hashed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from careloom.llm import linear
from careloom.llm.bits import bitmap, maybe_in
from careloom.llm.text import ALNUM, Words, as_texts, slices, split_words
from careloom.llm.tokens import Remembered
from careloom.session import cut_lineage

#: Hashed features, and the lengths of beginnings that count as one.
SIZE, BEGINNINGS = 1 << 20, (4, 5, 6)
#: Labelled rows that a model is fitted on at most: those with the smallest hashes.
MOST_LABELLED = 20_000
#: Features of a model at most: those that tell the labels apart best.
MOST_FEATURES = 4096
#: Weight of the score changes that swaps cause.
SWAP_COST = 10.0

#: Sets of terms that may stand for each other, in four languages; the first of a set is the neutral one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("someone", "gay", "lesbian", "straight", "transgender", "queer"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("citizens", "immigrants", "refugees", "foreigners", "natives"),
    ("human", "black", "white", "asian", "latino", "african", "european", "arab"),
    ("grown", "old", "young", "disabled", "deaf", "blind"),
    ("menschen", "frauen", "männer", "mädchen", "jungen"),
    ("mensch", "frau", "mann", "schwuler", "lesbe", "transfrau", "transmann"),
    ("gläubige", "christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("religiöse", "christliche", "muslimische", "jüdische", "hinduistische", "buddhistische"),
    ("bürger", "einwanderer", "flüchtlinge", "ausländer", "migranten"),
    ("menschliche", "schwarze", "weiße", "asiatische", "afrikanische", "arabische", "türkische"),
    ("erwachsene", "alte", "junge", "behinderte", "gehörlose", "blinde"),
    ("gens", "femmes", "hommes", "filles", "garçons"),
    ("personne", "femme", "homme", "gay", "lesbienne", "homosexuel", "transgenre"),
    ("croyants", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("religieux", "chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("citoyens", "immigrés", "réfugiés", "étrangers", "migrants"),
    ("humain", "noir", "blanc", "asiatique", "africain", "arabe", "européen"),
    ("adultes", "vieux", "jeunes", "handicapés", "sourds", "aveugles"),
    ("gente", "mujeres", "hombres", "niñas", "niños"),
    ("persona", "mujer", "hombre", "gay", "lesbiana", "homosexual", "transgénero"),
    ("creyentes", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("religioso", "cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("ciudadanos", "inmigrantes", "refugiados", "extranjeros", "migrantes"),
    ("humano", "negro", "blanco", "asiático", "latino", "africano", "árabe", "europeo"),
    ("adultos", "viejos", "jóvenes", "discapacitados", "sordos", "ciegos"),
)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder by 5; never of a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hashed(word: str) -> tuple[int, ...]:
    parts = [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return tuple(zlib.crc32(p.encode()) % SIZE for p in parts)


def distinct_pairs(row: np.ndarray, feature: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.int64) * size + feature)
    return both // size, both % size


def features(words: Words, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every feature that a row has, each once."""
    each = known(words.distinct.to_pylist())
    count = np.array([len(e) for e in each], dtype=np.int64)
    flat = np.array([f for e in each for f in e], dtype=np.int64)
    return gathered(words, count, flat, SIZE)


def gathered(words: Words, count: np.ndarray, flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    row, word = distinct_pairs(words.row, words.index, max(len(count), 1))
    if not len(word):
        return row, word
    n = count[word]
    ends = np.cumsum(n)
    pick = np.arange(int(ends[-1])) + np.repeat((np.cumsum(count) - count)[word] - (ends - n), n)
    return distinct_pairs(np.repeat(row, n), flat[pick], size)


def swaps(words: set[str], terms) -> list[tuple[set[int], set[int]]]:
    """Features that each swap of one identity term takes from a text and adds to it."""
    out = []
    for group in terms:
        for term in group:
            if term in words:
                out += [(set(hashed(term)) - set(hashed(o)), set(hashed(o)) - set(hashed(term))) for o in group if o != term]
    return out


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, known: Remembered) -> np.ndarray:
        words = split_words(texts, ALNUM)
        total = np.full(len(texts), self.bias)
        each = known(words.distinct.to_pylist())
        count = np.array([len(e) for e in each], dtype=np.int64)
        if count.any():
            some = count[words.index] > 0
            own = Words(words.distinct, words.index[some], words.row[some], words.rows)
            row, feature = gathered(own, count, np.array([f for e in each for f in e], np.int64), len(self.weights))
            total += np.bincount(row, weights=self.weights[feature], minlength=len(texts))
        return linear.sigmoid(total)

    def known(self) -> Remembered:
        place = {int(f): i for i, f in enumerate(self.features)}
        return Remembered(lambda words: [tuple(place[f] for f in hashed(w) if f in place) for w in words])


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, most: int, terms) -> DataFrame:
    """Features and swaps of at most ``most`` distinct labelled texts, and how often each occurs."""
    chosen = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    chosen = cut_lineage(chosen.orderBy(F.xxhash64("id"), "id", "label").limit(most))
    bits = bitmap(chosen, F.xxhash64("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("h"))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(bits, b.column(2).to_numpy())))

    # a combining aggregate: of a row that fills a third of the table each task hands on one
    distinct = rows.mapInArrow(maybe, rows.schema).groupBy("id", "text").agg(F.count(F.lit(1)).alias("n"))
    drawn = cut_lineage(distinct.join(chosen, "id").orderBy(F.xxhash64("id"), "id", F.md5("text"), "label").limit(most))
    schema = "label int, n long, features array<int>, swaps array<struct<gone:array<int>,come:array<int>>>"
    arrow = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))]))
    every = {t for group in terms for t in group}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda words: [hashed(w) for w in words])
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(as_texts(batch.column(2)), ALNUM)
                row, feature = features(words, known)
                at = np.searchsorted(row, np.arange(words.rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
                names = np.array([w in every for w in words.distinct.to_pylist()], dtype=bool)
                said: dict[int, set[str]] = {}
                for i in np.flatnonzero(names[words.index]) if names.any() else ():
                    said.setdefault(int(words.row[i]), set()).add(words.distinct[int(words.index[i])].as_py())
                swapped = [[{"gone": list(a), "come": list(b)} for a, b in swaps(said.get(i, set()), terms)] for i in range(words.rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(swapped, arrow)], names=["label", "n", "features", "swaps"])

    return cut_lineage(drawn.select("label", "n", "text").mapInArrow(run, schema))


def telling_features(rows: DataFrame, most: int) -> np.ndarray:
    """The features whose share differs most surely between the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE), np.int64)
        for b in batches:
            label = b.column(0).to_numpy()
            lists = b.column(1)
            row = np.repeat(label, lists.value_lengths().to_numpy())
            for y in (0, 1):
                counts[y] += np.bincount(lists.flatten().to_numpy()[row == y], minlength=SIZE)
        found = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[0][found]), pa.array(counts[1][found])], names=["f", "n0", "n1"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total0, total1 = sizes.get(0, 0), sizes.get(1, 0)
    if not total0 or not total1:
        return np.zeros(0, np.int64)
    counts = rows.select("label", "features").mapInArrow(run, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / F.lit(total0 + total1)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / total0 + 1 / total1)) + 1e-12
    sure = F.abs(F.col("n1") / F.lit(total1) - F.col("n0") / F.lit(total0)) / spread
    best = counts.filter(F.col("n0") + F.col("n1") >= 3).withColumn("sure", sure).filter("sure >= 4").orderBy(F.desc("sure"), "f").limit(most)
    return np.sort(np.array([r["f"] for r in best.select("f").collect()], dtype=np.int64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED,
                 terms=IDENTITY_TERMS, swap_cost: float = SWAP_COST) -> ToxicityModel:
    """A model of the labelled texts.

    Labels other than 0 and 1 are left out, as are labels without a text and texts without a
    label. Rows that repeat id and text are one row that weighs as much as all; at most ``most`` distinct
    rows, those of the smallest hashes, reach the driver. With no labels, or those of one class only, every text gets the same score:
    the share of toxic labels, 0 if there are none.
    """
    rows = labelled_features(docs, labels, id_col, text, label, most, terms)
    extra = np.array(sorted({f for group in terms for t in group for f in hashed(t)}), dtype=np.int64)
    chosen = np.union1d(telling_features(rows, MOST_FEATURES), extra)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.flatnonzero(np.isin(chosen, f)).tolist() for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.list_(pa.int32())), b.column(3)], names=["label", "n", "features", "swaps"])

    data = rows.mapInArrow(place, rows.schema).toPandas()  # at most ``most`` rows of chosen features
    target = data["label"].to_numpy(float)
    if not len(target) or target.min() == target.max():
        return ToxicityModel(chosen, np.zeros(len(chosen)), 20.0 if len(target) and target[0] else -20.0)
    order = np.lexsort([data["features"].map(lambda f: hash(tuple(f))), target])
    own = [np.asarray(f, np.int64) for f in data["features"].iloc[order]]
    where = {int(f): i for i, f in enumerate(chosen)}
    index, value = [], []
    for one in data["swaps"]:
        for s in one:
            gone, come = [where[f] for f in s["gone"] if f in where], [where[f] for f in s["come"] if f in where]
            index.append(np.array(gone + come, np.int64))
            value.append(np.array([-1.0] * len(gone) + [1.0] * len(come)))
    weights, bias = linear.fit(linear.Rows(own), target[order], len(chosen), data["n"].to_numpy(float)[order], l2=1e-4, changes=linear.Rows(index, value), change_cost=swap_cost)
    return ToxicityModel(chosen, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score", toxic: str = "predicted", bar: float = 0.5) -> DataFrame:
    """Adds the score of every whole text and whether it reaches ``bar``.

    Null and empty texts are scored by the bias alone. Rows and further columns pass
    through; columns named like the results are replaced.
    """
    kept = docs.drop(score, toxic)
    at = kept.columns.index(text)
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType()), StructField(toxic, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                found = model.scores(as_texts(batch.column(at)), known)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(found >= bar)], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)
