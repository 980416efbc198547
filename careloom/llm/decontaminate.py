"""Benchmark passages inside training documents (operator 2).

Method: winnowing. Of every ``SPAN - K + 1`` neighbouring k-gram hashes of a text the smallest
one is kept as a fingerprint. Two texts that share a span of ``SPAN`` words therefore share
a fingerprint at the same place in the span. Fingerprints of documents and items are joined,
and each match is extended word by word to both sides; it counts where it covers a whole window.
An item shorter than a window is one window of its own length, fingerprinted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from careloom.llm.bits import bitmap, maybe_in, parted
from careloom.llm.text import ALNUM, Words, as_texts, gram_hashes, mixed, slices, split_words
from careloom.session import cut_lineage

#: Words of a window, and of a fingerprinted gram in it.
SPAN, K = 10, 5

MARK = StructType([StructField("print", LongType()), StructField("at", LongType()), StructField("first", LongType()), StructField("words", ArrayType(StringType()))])


def least_grams(hashes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the smallest gram, the first of equal ones, in every ``span`` words; and all grams.

    The least of a stretch is that of two stretches that cover it, so their length doubles every time.
    """
    grams = gram_hashes(hashes, k)
    width = span - k + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at, covered = grams, np.arange(len(grams)), 1
    while covered < width:
        step = min(covered, width - covered)
        n = len(least) - step
        less = least[step:] < least[:n]
        least, at = np.where(less, least[step:], least[:n]), np.where(less, at[step:], at[:n])
        covered += step
    return at, grams


def winnowed(hashes: np.ndarray, row: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints chosen from the words of many rows laid end to end."""
    at, grams = least_grams(hashes, span, k)
    chosen = np.unique(at[row[: len(at)] == row[span - 1:]]) if len(at) else at
    return chosen, grams[chosen]


def short_grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every gram of ``n`` words, salted by its length."""
    grams = gram_hashes(hashes, n)
    at = np.flatnonzero(row[: len(grams)] == row[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return at, mixed(grams[at] + np.uint64(n))


def marks(words: Words, span: int, k: int, short: list[int], bits: np.ndarray | None, own_length: bool) -> list[list[dict]]:
    """Fingerprints of each row with the words around them that a window can reach.

    ``own_length`` is the items' side, where only a row of exactly ``n`` words has a short
    gram; a document has all of them for each length that occurs among the items.
    """
    hashes, row, bounds = words.hashes(), words.row, words.bounds
    length = np.diff(bounds)
    found = [(*winnowed(hashes, row, span, k), span - k, span)]
    for n in short:
        at, prints = short_grams(hashes, row, n)
        if own_length:
            own = length[row[at]] == n
            at, prints = at[own], prints[own]
        found.append((at, prints, 0, n))
    out: list[list[dict]] = [[] for _ in range(words.rows)]
    for at, prints, before, reach in found:
        if bits is not None:
            sure = maybe_in(bits, prints)
            at, prints = at[sure], prints[sure]
        for p, h in zip(at.tolist(), prints.view(np.int64).tolist(), strict=True):
            r = row[p]
            lo, hi = max(p - before, bounds[r]), min(p + reach, bounds[r + 1])
            near = words.distinct.take(pa.array(words.index[lo:hi])).to_pylist()
            out[r].append({"print": h, "at": p - bounds[r], "first": lo - bounds[r], "words": near})
    return out


def marked(rows: DataFrame, span: int, k: int, short: list[int], bits: np.ndarray | None, own_length: bool) -> DataFrame:
    """Number of words and fingerprints of every row of (id, text)."""
    schema = StructType([rows.schema[0], StructField("n_words", LongType()), StructField("marks", ArrayType(MARK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(as_texts(batch.column(1)), ALNUM)
                counts = pa.array(np.diff(words.bounds))
                found = pa.array(marks(words, span, k, short, bits, own_length), MARKS_ARROW)
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, found], names=schema.names)

    return rows.mapInArrow(run, schema)


MARKS_ARROW = pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))]))


def extended(pairs: DataFrame, span: int) -> DataFrame:
    """Word ranges of documents over which a match agrees with its item, window length at least."""

    def run(batches):
        for b in batches:
            spans = [reach(*x, span) for x in zip(b["words"], b["place"], b["item_words"], b["item_place"], b["item_length"], strict=True)]
            keep = np.array([s is not None for s in spans], dtype=bool)
            out = b.loc[keep, ["row_no", "item"]].copy()
            good = [s for s in spans if s is not None]
            start = b["at"][keep].to_numpy()
            out["start"], out["end"] = start - [s[0] for s in good], start + [s[1] for s in good]
            yield out.astype({"start": "int64", "end": "int64"})

    schema = StructType([StructField("row_no", LongType()), pairs.schema["item"], StructField("start", LongType()), StructField("end", LongType())])
    return pairs.mapInPandas(run, schema)


def reach(words, at: int, other, other_at: int, other_length: int, span: int) -> tuple[int, int] | None:
    """Equal words to the left and from ``at`` to the right, if together they fill a window."""
    left = right = 0
    while left < min(at, other_at) and words[at - 1 - left] == other[other_at - 1 - left]:
        left += 1
    while right < min(len(words) - at, len(other) - other_at) and words[at + right] == other[other_at + right]:
        right += 1
    return (left, right) if left + right >= min(span, other_length) else None


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """For every row of ``docs``: id, n_words, n_hit, items (sorted ids as strings) and spans.

    A word is hit inside any occurrence of a window of any item. Null and empty texts have no
    words and no hits. Repeated rows each get a row. Items without words hit nothing; an item
    without id hits words but is not listed; repeated ids are listed once. Further columns of
    either table are not read. An empty ``docs`` gives an empty table; with no items nothing is hit.

    Only document fingerprints that a bitmap of fixed size holds go to the join; the join
    itself carries no hint, so a fingerprint that many documents hold can be split.
    """
    item_rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    short = list(range(1, span))
    listed = cut_lineage(marked(item_rows, span, k, short, None, True).filter("n_words > 0"))
    # only lengths that occur need grams of the documents: span - 1 numbers at most
    short = sorted(r[0] for r in listed.filter(F.col("n_words") < span).select("n_words").distinct().collect())
    prints = listed.select("item", F.col("n_words").alias("item_length"), F.explode("marks").alias("m"))
    prints = prints.select("item", "item_length", F.col("m.print").alias("print"), (F.col("m.at") - F.col("m.first")).alias("item_place"), F.col("m.words").alias("item_words"))
    bits = bitmap(prints, F.col("print"))
    doc_rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    base = cut_lineage(marked(doc_rows, span, k, short, bits, False).withColumn("row_no", F.monotonically_increasing_id()))
    hits = base.select("row_no", F.explode("marks").alias("m"))
    hits = hits.select("row_no", F.col("m.print").alias("print"), F.col("m.at").alias("at"), (F.col("m.at") - F.col("m.first")).alias("place"), F.col("m.words").alias("words"))
    # one item row per distinct context: many places of an item can look alike
    found = extended(hits.join(prints.distinct(), "print"), span)
    by_item = found.groupBy("row_no", "item").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    ranges = by_item.select("row_no", F.explode("ranges").alias("r")).distinct().select("row_no", "r.start", "r.end")
    before = Window.partitionBy("row_no").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.col("end") - F.greatest("start", "seen"), F.lit(0))
    words_hit = ranges.groupBy("row_no").agg(F.sum(fresh).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = by_item.groupBy("row_no").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = base.drop("marks").join(words_hit, "row_no", "left").join(named, "row_no", "left")
    none = F.array().cast(ArrayType(StringType()))
    no_spans = F.array().cast(ranges_type())
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", no_spans).alias("spans"))


def ranges_type() -> ArrayType:
    return ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item, whatever their ids.

    The verdict is joined back by the text's digest: rows of one id but of different texts
    have one each, and so have rows without an id.
    """
    rows = docs.withColumn("__key", F.md5(F.col(text).cast("string")))
    found = find_items(rows, items, "__key", text, item_id, item_text)
    hit = cut_lineage(found.filter("n_hit > 0").select(F.col("__key").alias("__hit")).distinct())
    whole, maybe = parted(rows, F.col("__key"), hit, "__hit")
    return whole.unionByName(maybe.join(hit, F.col("__key") == F.col("__hit"), "left_anti")).drop("__key")
