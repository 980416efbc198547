"""Spelling variants of a corpus's words (operator 11).

Method: Bloom-guided neighbourhoods. Words are counted, and the vocabulary is entered into
blocked Bloom filters, one shard per word length. Every word's edits are generated as hashes: from
the word's own polynomial hash, an edit's hash takes two additions. Edits are probed against the
shard of their length; only positives are shuffled, to a join with the exact vocabulary that
removes false positives, also those of equal hashes.

Deletions reach the shorter of two words from the longer one, and replacements are generated
towards smaller characters only, so that every near pair is generated exactly once.

The filters broadcast have a bounded size: a larger vocabulary is dealt by hash into parts, and
each part's filters are probed by all edits in a round of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from careloom.llm.text import Words, as_texts, mixed, slices, split_words
from careloom.session import cut_lineage

#: Words shorter than this are no words of the vocabulary, nor are those that occur less often.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Words whose filters are broadcast at once: 16 bits each, 32 MB at most.
MOST_WORDS = 1 << 24
BITS_PER_WORD = 16
#: Bits of a block, and how many of them a word sets.
BLOCK, SET_BITS = 512, 6
#: Lengths from here on share a shard.
LAST_SHARD = 64
#: Letters whose edits are worked on at once.
CELLS = 1 << 18
#: Runs are ASCII letters and U+00C0 to U+00FF: the code points of Latin-1.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint8)
#: An odd factor, its inverse and a value per letter of the polynomial hash.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Bits of one row of Spark's bitmap aggregate.
ROW_BITS = 32768


# --- words ----------------------------------------------------------------------------------


def letter_runs(texts: pa.Array) -> Words:
    """Maximal runs of letters, A-Z lower-cased; every other character parts them."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    body = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    low = body | np.uint8(0x20)
    letter = (low >= 0x61) & (low <= 0x7A)
    lead = body == 0xC3  # U+00C0 to U+00FF are this byte and one more
    letter |= lead
    letter[1:] |= lead[:-1]
    upper = (body >= 0x41) & (body <= 0x5A)
    clean = np.where(letter, np.where(upper, low, body), np.uint8(0x20))
    return split_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(clean)), None)


def crc_tables(length: int) -> np.ndarray:
    """What a checksum's four bytes become after ``length`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    out = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(length):
        out = step[out & 0xFF] ^ (out >> np.uint32(8))
    return out


class Checksums:
    """crc32 of ``<id>:<run>`` from one checksum per id and one per distinct run."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def of(self, ids: list[str], words: Words) -> np.ndarray:
        head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        coded = [w.encode() for w in words.distinct.to_pylist()]
        size = np.array([len(w) for w in coded], dtype=np.int64)
        tail = np.array([zlib.crc32(w) for w in coded], dtype=np.uint32)
        if not len(words.index):
            return np.zeros(0, np.uint32)
        start = head[words.row]
        out = tail[words.index]
        length = size[words.index]
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cuts):
            n = int(length[part[0]])
            table = self.table(n)
            s = start[part]
            out[part] ^= table[0][s & 0xFF] ^ table[1][(s >> np.uint32(8)) & 0xFF] ^ table[2][(s >> np.uint32(16)) & 0xFF] ^ table[3][s >> np.uint32(24)]
        return out

    def table(self, n: int) -> np.ndarray:
        if n > 4096:
            return crc_tables(n)
        if n not in self.tables:
            self.tables[n] = crc_tables(n)
        return self.tables[n]


def damaged(run: str, checksum: int) -> str:
    """The run without the code point that the checksum names."""
    at = checksum % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str, text: str, every: int, least: int) -> DataFrame:
    """(word, n) of every slice of texts: counts still to be added up."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for whole in batches:
            for batch in slices(whole, "text"):
                words = letter_runs(as_texts(batch.column(1)))
                ids = pc.fill_null(batch.column(0), "").to_pylist()
                hashed = sums.of(ids, words)
                hit = hashed % np.uint32(every) == 0 if every else np.zeros(len(hashed), bool)
                count = np.bincount(words.index[~hit], minlength=len(words.distinct))
                length = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False) if len(words.distinct) else np.zeros(0, np.int64)
                keep = np.flatnonzero((count > 0) & (length >= least))
                yield pa.RecordBatch.from_arrays([words.distinct.take(pa.array(keep)).cast(pa.string()), pa.array(count[keep].astype(np.int64))], names=schema.names)
                at = np.flatnonzero(hit)
                at = at[length[words.index[at]] > least] if len(at) else at
                if len(at):
                    runs = words.distinct.take(pa.array(words.index[at])).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([damaged(w, h) for w, h in zip(runs, hashed[at].tolist(), strict=True)], pa.string()), pa.array(np.ones(len(at), np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


# --- hashes and edits -----------------------------------------------------------------------


@dataclass
class Flat:
    """Words laid end to end as Latin-1 bytes."""

    code: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Flat:
        coded = [w.encode("latin-1") for w in words]
        length = np.array([len(w) for w in coded], dtype=np.int64)
        return cls(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(length) - length, length)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), FACTOR, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def raw_hashes(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every letter, the words' polynomial hashes, and running sums before each letter."""
    row = np.repeat(np.arange(len(flat.length)), flat.length)
    place = np.arange(len(flat.code)) - flat.start[row]
    power = powers(int(flat.length.max(initial=1)))
    with np.errstate(over="ignore"):
        term = VALUES[flat.code] * power[place]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        whole = running[flat.start + flat.length] - running[flat.start]
        before = running[:-1] - running[flat.start][row]
    return row, place, whole, before


def finished(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of a word: its polynomial mixed with its length."""
    with np.errstate(over="ignore"):
        return mixed(raw + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def edits(flat: Flat, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (hash, row, place, letter) of the edits; letter 0 stands for a deletion.

    Of a run of equal letters only the last is deleted, so that no edit comes twice.
    """
    row, place, whole, before = raw_hashes(flat)
    power = powers(int(flat.length.max(initial=1)))
    inverse = np.uint64(INVERSE)
    with np.errstate(over="ignore"):
        for lo in range(0, len(row), CELLS):
            cut = slice(lo, lo + CELLS)
            r, p, code = row[cut], place[cut], flat.code[cut]
            here = VALUES[code] * power[p]
            following = np.append(flat.code[lo + 1: lo + 1 + len(r)], np.uint8(0))[: len(r)]
            last = (p == flat.length[r] - 1) | (following != code)
            at = np.flatnonzero(last & (flat.length[r] > least))
            if len(at):
                rest = whole[r[at]] - before[cut][at] - here[at]
                yield finished(before[cut][at] + rest * inverse, flat.length[r[at]] - 1), r[at], p[at], np.zeros(len(at), np.int32)
            without = whole[r] - here
            for letter in LETTERS[:-1].tolist():
                at = np.flatnonzero(code > letter)
                if len(at):
                    yield finished(without[at] + VALUES[letter] * power[p[at]], flat.length[r[at]]), r[at], p[at], np.full(len(at), letter, np.int32)


# --- filters --------------------------------------------------------------------------------


@dataclass
class Filters:
    """Blocked Bloom filters laid end to end: first block and number of blocks of each shard."""

    first: np.ndarray
    blocks: np.ndarray
    bits: np.ndarray

    def maybe(self, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that may have been entered."""
        shard = np.minimum(length, LAST_SHARD)
        at = np.flatnonzero(self.blocks[shard] > 0)
        block = block_of(hashes[at], self.first[shard[at]], self.blocks[shard[at]])
        spread = bit_source(hashes[at])
        for i in range(SET_BITS):
            bit = block * BLOCK + bit_of(spread, i)
            good = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            at, block, spread = at[good], block[good], spread[good]
        return at


def block_of(hashes: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    high = (hashes >> np.uint64(32)).astype(np.int64)
    return first + ((high * blocks) >> 32)


def bit_source(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes ^ np.uint64(0xA0761D6478BD642F))


def bit_of(spread: np.ndarray, i: int) -> np.ndarray:
    return ((spread >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)).astype(np.int64)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the vocabulary that a hash belongs to."""
    return (mixed(hashes + np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def hashed_vocabulary(counted: DataFrame, parts: int) -> DataFrame:
    """Adds ``hash``, ``length`` and ``part`` to (word, n)."""
    schema = StructType([*counted.schema.fields, StructField("hash", LongType()), StructField("length", LongType()), StructField("part", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat.of(batch.column(0).to_pylist())
            hashes = finished(raw_hashes(flat)[2], flat.length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.view(np.int64)), pa.array(flat.length), pa.array(part_of(hashes, parts))], names=schema.names)

    return counted.mapInArrow(run, schema)


def build_filters(words: DataFrame) -> Filters:
    """Filters of (hash, length). The driver gets them as bitmap rows of 4 KB, never the words."""
    shard = F.least(F.col("length"), F.lit(LAST_SHARD))
    sizes = {r["s"]: r["c"] for r in words.groupBy(shard.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}
    blocks = np.zeros(LAST_SHARD + 1, np.int64)
    for s, c in sizes.items():
        blocks[s] = -(-c * BITS_PER_WORD // BLOCK)
    first = np.cumsum(blocks) - blocks
    schema = StructType([StructField("bit", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            s = np.minimum(batch.column(1).to_numpy(), LAST_SHARD)
            block, spread = block_of(hashes, first[s], blocks[s]), bit_source(hashes)
            bits = np.concatenate([block * BLOCK + bit_of(spread, i) for i in range(SET_BITS)])
            yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    places = words.select("hash", "length").mapInArrow(run, schema)
    rows = places.groupBy(F.expr(f"bit div {ROW_BITS}").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bits"))
    width = ROW_BITS // 8
    total = int(blocks.sum()) * BLOCK // 8
    out = np.zeros(-(-total // width) * width, np.uint8)
    for r in rows.collect():
        out[r["part"] * width: (r["part"] + 1) * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Filters(first, blocks, out)


def probed(vocabulary: DataFrame, filters: Filters, part: int, parts: int, least: int) -> DataFrame:
    """(source id, edit's hash, place, letter) of the edits that may be words of this part."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)
    schema = StructType([StructField("source", LongType()), StructField("target", LongType()), StructField("place", IntegerType()), StructField("letter", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy()
            flat = Flat.of(batch.column(0).to_pylist())
            for hashes, row, place, letter in edits(flat, least):
                length = flat.length[row] - (letter[0] == 0)
                if parts > 1:
                    mine = np.flatnonzero(part_of(hashes, parts) == part)
                    hashes, row, place, letter, length = hashes[mine], row[mine], place[mine], letter[mine], length[mine]
                at = shared.value.maybe(hashes, length)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[at]]), pa.array(hashes[at].view(np.int64)), pa.array(place[at].astype(np.int32)), pa.array(letter[at])], names=schema.names)

    return vocabulary.select("word", "id").mapInArrow(run, schema)


# --- groups ---------------------------------------------------------------------------------


def near_pairs(vocabulary: DataFrame, parts: int, least: int) -> DataFrame:
    """(a, n_a, b, n_b) of words that differ by one edit, each pair once."""
    positives = None
    for part in range(parts):
        filters = build_filters(vocabulary.filter(F.col("part") == part))
        found = probed(vocabulary, filters, part, parts, least)
        positives = found if positives is None else positives.unionByName(found)
    known = vocabulary.select(F.col("hash").alias("target"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    source = vocabulary.select(F.col("id").alias("source"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    pairs = positives.join(known, "target").join(source, "source")
    # equal hashes aren't equal words: the edit itself must give the word
    rest = F.expr("substring(a, place + 2)")
    edited = F.concat(F.expr("substring(a, 1, place)"), F.when(F.col("letter") > 0, F.expr("char(letter)")).otherwise(""), rest)
    return pairs.filter(edited == F.col("b")).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed by doubling.

    A form occurs at least ten times as often as its word, so that no chain has over 19 links.
    """
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        step = cut_lineage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = 31,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, most_words: int = MOST_WORDS, ratio: int = 10,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of the texts.

    Runs are maximal sequences of ASCII letters and U+00C0 to U+00FF with A-Z lower-cased. Where
    ``every`` divides crc32 of ``<id>:<run>`` one code point of the run is deleted (``every=0``: never).
    Words have ``least_length`` code points and ``least_count`` occurrences at least; near words differ by one
    inserted, deleted or replaced code point. The form is the near word of largest ``n``, the smallest
    of equal ones, if it occurs ``ratio`` times as often; the root is where forms end.

    Null and empty texts have no runs, and a null id counts as an empty one. Repeated rows count
    each time. Words of any length are taken. An empty table gives no rows; further columns are ignored.
    """
    totals = word_counts(docs, id_col, text, every, least_length).groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(totals.filter(F.col("n") >= least_count))
    parts = max(1, -(-counted.count() // most_words))
    vocabulary = cut_lineage(hashed_vocabulary(counted, parts).withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(vocabulary, parts, least_length)
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )).alias("s")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    found = pairs.select(sides).select("s.*").unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    wins = -F.col("best.minus") >= ratio * F.col("n")
    judged = cut_lineage(found.select("word", "n", "n_near", F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.minus")).alias("form_n")))
    ends = roots(judged.filter("form is not null"))
    out = judged.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
