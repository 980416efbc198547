"""Passages that repeat across documents (operator 5).

Method: paragraph MinHash banding. Paragraphs (lines) of at least ``least`` words are banded for high
recall; colliding ones are compared by the exact Jaccard similarity of their word shingles,
and components of similar paragraphs keep the one in the smallest document.

A passage need not be a paragraph: it can begin and end inside one, or run over several. So
that these are found as well, every window of ``least`` words is matched by its hash, and the
windows that a smaller document holds are merged. Content-anchored pieces of ``PIECE`` words spare
most windows that: pieces begin where winnowing of word grams puts an anchor, and all
that lie in a shared window by their anchors' own choice are shared pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from careloom.llm.banding import band_keys, blocked, clusters, digests, linked_components, numbered
from careloom.llm.bits import bitmap, maybe_in, parted
from careloom.llm.decontaminate import least_grams, winnowed
from careloom.llm.neardup import shingle_sets
from careloom.llm.text import SPACED, Words, as_texts, gram_hashes, mixed, slices, split_words
from careloom.session import cut_lineage

#: Words of a repeated passage at least.
LEAST_WORDS = 50
#: 12 bands of 3 values: two paragraphs of similarity 0.8 are missed once in 5,500 cases.
BANDS, ROWS = 12, 3
#: Words of an anchored piece; grams of so many words, of which one in so many is an anchor.
PIECE, GRAM, WIDTH = 16, 4, 20


def long_lines(texts: pa.Array, least: int) -> tuple[Words, Words, np.ndarray, np.ndarray]:
    """Words of the texts; those of the lines of ``least`` words and more, and these lines' texts and first words.

    A line end is white space, so that both come from one split.
    """
    lists = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = split_words(lists.flatten(), SPACED)
    count = np.diff(words.bounds)
    before = np.cumsum(count) - count
    first = before - before[np.searchsorted(doc, doc)]
    keep = count >= least
    place = np.cumsum(keep) - 1
    inside = keep[words.row]
    words.hashes()
    whole = Words(words.distinct, words.index, doc[words.row], len(texts), words.each)
    return whole, Words(words.distinct, words.index[inside], place[words.row[inside]].astype(np.int32), int(keep.sum()), words.each), doc[keep], first[keep]


def source_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null")


def told_apart(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``id, text`` in which every id has one text, and what the new ids stand for: ``no, id, text_key``.

    Rows without an id, and those whose id has several texts, get ids past the largest one in the
    order of id and text, so that the smallest document that keeps a passage has an id of its own
    where there is one. The second table is None where no row needs that.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    texts = rows.groupBy("id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
    several = cut_lineage(texts.filter("id is null or low <> high").select("id"))
    if several.isEmpty():
        return rows.select("id", "text"), None
    whole, maybe = parted(rows, F.col("id"), several, "id")
    odd = cut_lineage(maybe.filter("id is null").unionByName(maybe.join(several, "id", "left_semi")))
    plain = cut_lineage(maybe.filter("id is not null").join(several, "id", "left_anti").select("id", "text"))
    top = rows.agg(F.max("id")).first()[0]
    names = odd.select("id", "text_key").distinct().orderBy(F.col("id").asc_nulls_last(), "text_key")
    names = cut_lineage(names.withColumn("no", F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)))
    other = names.select("no", F.col("id").alias("odd_id"), F.col("text_key").alias("odd_key"))
    numbered_rows = odd.join(other, F.col("id").eqNullSafe(F.col("odd_id")) & (F.col("text_key") == F.col("odd_key")))
    numbered_rows = cut_lineage(numbered_rows.select(F.col("no").alias("id"), "text"))
    return whole.select("id", "text").unionByName(plain).unionByName(numbered_rows), names


PARAGRAPH = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def anchored(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every anchored piece, in the order of the words."""
    hashes, row, bounds = words.hashes(), words.row, words.bounds
    at, _ = winnowed(hashes, row, WIDTH + GRAM - 1, GRAM)
    at = at[at + PIECE <= bounds[row[at] + 1]]
    return row[at], gram_hashes(hashes, PIECE)[at].view(np.int64)


def per_row(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """The values as one list for every row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def read_once(rows: DataFrame, least: int) -> DataFrame:
    """``id``, the long ``paragraphs`` and the hashes of the anchored ``pieces`` of every text, from one pass.

    A paragraph is its start and length in words, the size of its shingle set, the set's digest as key, and bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, lines, doc, first = long_lines(as_texts(batch.column(1)), least)
                found = pa.array([], PARAGRAPH)
                if lines.rows:
                    row, value = shingle_sets(lines)
                    starts = np.searchsorted(row, np.arange(lines.rows))
                    bands = band_keys(value, starts, BANDS, ROWS).view(np.int64)
                    each = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                    found = pa.StructArray.from_arrays(
                        [pa.array(first.astype(np.int64)), pa.array(np.diff(lines.bounds)), pa.array(np.diff(np.append(starts, len(row)))), pa.array(digests(value, starts), pa.binary()), each],
                        fields=list(PARAGRAPH))
                of, piece = anchored(words)
                yield pa.RecordBatch.from_arrays([batch.column(0), per_row(doc, words.rows, found), per_row(of, words.rows, pa.array(piece))], names=["id", "paragraphs", "pieces"])

    return rows.mapInArrow(run, "id long, paragraphs array<struct<start: long, length: long, size: long, key: binary, bands: array<long>>>, pieces array<long>")


def paragraph_sets(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``key`` and ``set`` of the paragraphs of the documents that ``wanted`` names, and some more."""
    bits = bitmap(wanted, F.xxhash64("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(maybe_in(bits, whole.column(2).to_numpy())))
            for batch in slices(whole, "text"):
                _, words, _, _ = long_lines(as_texts(batch.column(1)), least)
                if not words.rows:
                    continue
                row, value = shingle_sets(words)
                starts = np.searchsorted(row, np.arange(words.rows))
                sets = [v.astype("<u8").tobytes() for v in np.split(value, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(digests(value, starts), pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "key binary, set binary")


def similar_paragraphs(rows: DataFrame, least: int, percent: int, read: DataFrame | None = None) -> DataFrame:
    """``id, start, end, kept`` of paragraphs whose component is kept in a smaller document.

    ``read`` is :func:`read_once` of the rows, checkpointed, where the caller has it.
    """
    read = cut_lineage(read_once(rows, least)) if read is None else read
    found = read.select("id", F.explode("paragraphs").alias("p")).select("id", "p.*")
    classes = numbered(found.groupBy("key").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.first("bands").alias("bands")))
    members = cut_lineage(blocked(classes.drop("bands").join(clusters(classes), "no")))
    # a paragraph of one document can stand in many places; its set is wanted once
    sets = paragraph_sets(rows, members, least).groupBy("key").agg(F.first("set").alias("set"))
    roots = linked_components(members.join(sets, "key"), percent)
    of_class = classes.select("key", "id", "no").join(roots, "no", "left").withColumn("root", F.coalesce("root", "no"))
    kept = of_class.join(of_class.groupBy("root").agg(F.min("id").alias("kept")), "root").select("key", "kept")
    return found.join(kept, "key").filter("id <> kept").select("id", "start", (F.col("start") + F.col("length")).alias("end"), "kept")


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Like ``gram_hashes`` with other values, at a cost that doesn't grow with ``n``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factor = 0x9E3779B97F4A7C15
    powers, back = (np.full(len(words), x, np.uint64) for x in (factor, pow(factor, -1, 1 << 64)))
    powers[0] = back[0] = 1
    with np.errstate(over="ignore"):
        powers, back = np.cumprod(powers), np.cumprod(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
        return mixed((total[n:] - total[:-n]) * back[: len(words) - n + 1])


def check_hashes(words: np.ndarray, pieces_: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """A second hash, of other make than ``window_hashes``, of the windows of ``n`` words at some places.

    It is put together from the hashes of pieces of ``PIECE`` words that cover the window.
    """
    if n < PIECE:
        return mixed(gram_hashes(words, n)[places] + np.uint64(1))
    out = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, n - PIECE, PIECE), n - PIECE]:
            out = mixed(out + pieces_[places + at])
    return out


@dataclass
class Regions:
    """Stretches of words in which every window of ``least`` words may be shared, laid end to end.

    ``row``, ``start`` and ``count`` of windows of every region; ``hashes`` of all its windows, and
    ``others``, which make them 128 bits a window.
    """

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    others: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count

    def offsets(self) -> np.ndarray:
        """Of every window in its region."""
        return np.arange(len(self.hashes)) - np.repeat(self.firsts, self.count)

    def keys(self) -> list[bytes]:
        """128 bits for the words of every region."""
        if not len(self.row):
            return []
        place = mixed(self.offsets().astype(np.uint64))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed(self.hashes ^ place), self.firsts)
            other = np.bitwise_xor.reduceat(mixed(self.others ^ place), self.firsts)
        both = np.stack([total, other], axis=1).astype("<u8").tobytes()
        return [both[i: i + 16] for i in range(0, len(both), 16)]

    def pairs(self) -> bytes:
        """Both hashes of every window, side by side."""
        return np.stack([self.hashes, self.others], axis=1).astype("<u8").tobytes()

    def tags(self, row_hash: np.ndarray) -> np.ndarray:
        """64 bits for the place of every region."""
        with np.errstate(over="ignore"):
            return mixed(row_hash.view(np.uint64)[self.row] + mixed(self.start.astype(np.uint64))).view(np.int64)


def regions(words: Words, bits: np.ndarray, least: int) -> Regions:
    """The regions of all rows: where every piece that a shared window must hold may be a shared one."""
    hashes, row, bounds = words.hashes(), words.row, words.bounds
    windows = window_hashes(hashes, least)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return Regions(none, none, none, windows, windows)
    may = row[: len(windows)] == row[least - 1:]
    inner = least - PIECE - WIDTH + 2
    piece = gram_hashes(hashes, PIECE)
    if inner > 0:
        # the anchors of the first ``inner`` places begin pieces that end inside the window
        at, _ = least_grams(hashes, WIDTH + GRAM - 1, GRAM)
        missed = np.concatenate([[0], np.cumsum(~maybe_in(bits, piece)[np.minimum(at, len(piece) - 1)])])
        may &= missed[inner: inner + len(windows)] == missed[: len(windows)]
    places = np.flatnonzero(may)
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (row[places[1:]] != row[places[:-1]])
    first = places[new]
    return Regions(row[first], first - bounds[row[first]], np.diff(np.append(np.flatnonzero(new), len(places))), windows[places], check_hashes(hashes, piece, least, places))


def region_rows(rows: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """``id, start, count`` of windows, ``key``, ``tag`` and the ``hashes``, two a window, of every region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                r = regions(split_words(as_texts(batch.column(1)), SPACED), bits, least)
                tags = r.tags(batch.column(2).to_numpy())
                ends = pa.array(np.append(r.firsts, len(r.hashes)) * 16, pa.int64())
                hashes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(r.row), [None, ends.buffers()[1], pa.py_buffer(r.pairs())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r.row)), pa.array(r.start), pa.array(r.count), pa.array(r.keys(), pa.binary()), pa.array(tags), hashes.cast(pa.binary())], names=["id", "start", "count", "key", "tag", "hashes"])

    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id long, start long, count long, key binary, tag long, hashes binary")


def each_window(regions_: DataFrame, wanted: np.ndarray, shared: np.ndarray | None) -> DataFrame:
    """``id, start, at`` and the hashes ``h, g`` of the windows of the regions whose tags are wanted, and of some more.

    With a bitmap of first hashes, of the windows that it may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(maybe_in(wanted, whole.column(2).to_numpy())))
            count = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) // 16
            hashes, others = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, 2).T.copy()
            of = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
            if shared is not None:
                some = np.flatnonzero(maybe_in(shared, hashes))
                of, at, hashes, others = of[some], at[some], hashes[some], others[some]
            place = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(at), pa.array(hashes), pa.array(others)], names=["id", "start", "at", "h", "g"])

    return regions_.select("id", "start", "tag", "hashes").mapInArrow(run, "id long, start long, at long, h long, g long")


def shared_passages(rows: DataFrame, least: int, read: DataFrame | None = None) -> DataFrame:
    """``id, start, end, kept`` of all words in windows of ``least`` words that a smaller document holds.

    Windows are compared by two 64-bit hashes of different make, so whoever else holds a part of
    one doesn't matter, and chance matches stay unlikely at any number of windows that a cluster can hold.
    Shared pieces mark the regions that are worth it. Equal regions are one class, of
    which the smallest document's windows are enough; the others' words are all held by it. ``read`` is
    :func:`read_once` of the rows, checkpointed, where the caller has it.
    """
    read = cut_lineage(read_once(rows, least)) if read is None else read
    pairs = read.select("id", F.explode("pieces").alias("h")).groupBy("h").agg(F.min("id").alias("kept"), F.max("id").alias("last")).filter("kept <> last")
    bits = bitmap(pairs, F.col("h"))
    found = cut_lineage(region_rows(rows, bits, least))
    classes = cut_lineage(found.groupBy("key").agg(F.min(F.struct("id", "start", "tag")).alias("first")).select("key", "first.*"))
    wanted = bitmap(classes, F.col("tag"))
    owners = each_window(found, wanted, None).groupBy("h", "g").agg(F.min("id").alias("kept"), F.max("id").alias("last"))
    owners = cut_lineage(owners.filter("kept <> last").select("h", "g", "kept"))
    held = each_window(found, wanted, bitmap(owners, F.col("h"))).join(owners, ["h", "g"]).filter("id <> kept")
    line = Window.partitionBy("id", "start").orderBy("at")
    runs = held.withColumn("new", (F.col("at") - F.coalesce(F.lag("at").over(line), F.lit(-2)) > 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "start", "run").agg(F.min("at").alias("low"), (F.max("at") + least).alias("high"), F.min("kept").alias("kept"))
    ranges = runs.groupBy("id", "start").agg(F.collect_list(F.struct("low", "high", "kept")).alias("ranges"), F.min("kept").alias("kept"))
    of_class = classes.select("key", F.col("id").alias("first"), F.col("start").alias("first_start"))
    of_class = of_class.join(ranges.withColumnsRenamed({"id": "first", "start": "first_start"}), ["first", "first_start"], "left").select("key", "first", "ranges", F.coalesce("kept", "first").alias("kept"))
    # alone in its class and with no window held elsewhere, a region says nothing
    members = found.drop("hashes").join(of_class, "key").filter("id <> first or ranges is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("count") + least - 1).alias("high"), F.col("kept")))
    each = members.select("id", "start", F.explode(F.when(F.col("id") == F.col("first"), F.col("ranges")).otherwise(whole)).alias("r"))
    return each.select("id", (F.col("start") + F.col("r.low")).alias("start"), (F.col("start") + F.col("r.high")).alias("end"), "r.kept")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, percent: int = 80) -> DataFrame:
    """``id, start, end, kept, text_key``: word ranges to remove from a document, and the one that keeps them.

    Ranges don't overlap or touch. Words are runs of anything but ASCII white space, compared with A-Z
    lower-cased. The smallest document of each component or shared run keeps its words; a
    passage that repeats in one document only stays. Null and empty texts have no ranges.
    Rows that share id and text are taken for one document repeated. Rows without an id, and those that share
    an id but not the text, are documents of their own that come after all others; ``text_key``, else
    null, is then the MD5 of the text that the range is of. Further columns are not read.
    """
    rows, names = told_apart(docs, id_col, text)
    read = cut_lineage(read_once(rows, least))
    found = similar_paragraphs(rows, least, percent, read).unionByName(shared_passages(rows, least, read)).distinct()
    # one order for both: equal ranges that two documents keep must not change places in between
    order = Window.partitionBy("id").orderBy("start", "end", "kept")
    new = F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    joined = found.withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(order))
    spans = joined.groupBy("id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept").alias("kept")).drop("part")
    if names is None:
        return cut_lineage(spans.withColumn("text_key", F.lit(None).cast("string")))
    of = names.select(F.col("no").alias("id"), F.col("id").alias("own"), "text_key")
    keeps = names.select(F.col("no").alias("kept"), F.col("id").alias("keeper"), F.lit(True).alias("odd"))
    spans = spans.join(of, "id", "left").join(keeps, "kept", "left")
    own, keeper = F.when(F.col("text_key").isNull(), F.col("id")).otherwise(F.col("own")), F.when(F.col("odd"), F.col("keeper")).otherwise(F.col("kept"))
    return cut_lineage(spans.select(own.alias("id"), "start", "end", keeper.alias("kept"), "text_key"))


def cut(text: str, spans) -> str:
    """The text without the words of the ranges; what is left on both sides meets in one line end."""
    marks = text.encode().translate(SPACED) + b" "
    data = text.encode()
    at, words = 0, []
    for w in marks.split(b" "):
        if w:
            words.append((at, at + len(w)))
        at += len(w) + 1
    left, last = [], 0
    for start, end in spans:
        left.append(data[last: words[start][0]])
        last = words[end - 1][1]
    left.append(data[last:])
    return "\n".join(x.decode().strip(" \t\n\x0b\x0c\r") for x in left if x.strip())


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the ranges of :func:`repeated_spans`; a document that loses all its words goes.

    All columns stay, the text is the shortened one; documents without ranges stay as they are.
    """
    listed = spans.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    listed = cut_lineage(listed.withColumnsRenamed({"id": "__id", "text_key": "__key", "ranges": "__ranges"}))
    key = F.col(id_col).cast("long")
    whole, maybe = parted(docs, key, listed, "__id")
    joined = maybe.join(listed.filter("__key is null").drop("__key"), key == F.col("__id"), "left").drop("__id")
    odd = listed.filter("__key is not null").withColumnRenamed("__ranges", "__own")
    if not odd.isEmpty():
        same = key.eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("__key"))
        joined = joined.join(odd, same, "left").withColumn("__ranges", F.coalesce("__own", "__ranges"))
    at = docs.columns.index(text)
    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = b.column(len(schema))
            texts = b.column(at).to_pylist() if ranges.null_count < len(b) else None
            keep = np.ones(len(b), bool)
            if texts is not None:
                for i in np.flatnonzero(pc.is_valid(ranges).to_numpy(zero_copy_only=False)):
                    texts[i] = cut(texts[i], [(r["start"], r["end"]) for r in ranges[int(i)].as_py()])
                    keep[i] = bool(texts[i])
            columns = [pa.array(texts, pa.string()) if i == at and texts is not None else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return whole.unionByName(joined.select(*docs.columns, "__ranges").mapInArrow(run, schema))
