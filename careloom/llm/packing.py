"""Best-fit packing of token sequences (operator 10).

Method: hierarchical residual packing. Pieces are dealt into groups of bounded size and
packed best-fit inside each; bins that are nearly full are done. Underfull bins go on as
items of their own: every round deals them into fewer groups and packs them best-fit again,
until one group holds them all or a round no longer pays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from careloom.llm.text import as_texts, slices
from careloom.llm.tokens import text_ids, word_ids
from careloom.session import cut_lineage

#: Items of a group, packed in one task.
GROUP_ITEMS = 8192
#: A bin with less room than this share of the capacity is done.
NEARLY_FULL = 0.01
#: A round must save this share of the open bins for another one to follow.
LEAST_GAIN = 0.01
#: Separates the group's number from the bin's within the group.
GROUP_BINS = 1 << 20


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut at ``capacity``.

    Only documents longer than ``capacity`` are cut. A null or empty text is the end id
    alone. Returns the id, piece, start, length and ids_crc32; ids themselves are not kept.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    schema = StructType([StructField(id_col, rows.schema["doc"].dataType), *(StructField(c, LongType()) for c in ("piece", "start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                row, start, length, crc = [], [], [], []
                ids, bounds = text_ids(as_texts(batch.column(1)), coder)
                view = memoryview(ids).cast("B")
                bounds = bounds.tolist()
                for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    for at in range(0, hi - lo + 1, capacity):
                        n = min(hi - lo - at, capacity)
                        own = zlib.crc32(view[(lo + at) * 4: (lo + at + n) * 4])
                        closes = n < capacity
                        row.append(i)
                        start.append(at)
                        length.append(n + closes)
                        crc.append(zlib.crc32(end, own) if closes else own)
                start = np.array(start, dtype=np.int64)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *map(pa.array, (start // capacity, start, np.array(length, np.int64), np.array(crc, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with room r is open
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            stack = by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, at, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = at, capacity - room
        if left := room - n:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins, offsets


def dealt(items: DataFrame, groups: int, round_no: int) -> DataFrame:
    """Items with a group by the hash of their place, never of their content."""
    return items.withColumn("group_no", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), F.lit(groups)))


def pack(items: DataFrame, capacity: int, length: str = "length", sequence: str = "sequence_id", offset: str = "offset") -> DataFrame:
    """Adds the sequence and the offset of every item; items longer than ``capacity`` are an error.

    ``items`` must be stable when it is read again (a checkpoint or a written table). Every
    sequence is filled without gaps from 0. Repeated and null rows are items like others; an
    empty table gives an empty one. Columns named like the results are replaced.
    """
    items = items.drop(sequence, offset, "group_no")
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    schema = StructType([*items.schema.fields, *(StructField(c, LongType()) for c in (sequence, offset, "fill"))])

    def first(key, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(rows[length].to_numpy(), capacity)
        fill = np.bincount(bins, weights=rows[length]).astype(np.int64)
        rows[sequence], rows[offset], rows["fill"] = bins + key[0] * GROUP_BINS, offsets, fill[bins]
        return rows.drop(columns="group_no")

    placed = cut_lineage(dealt(items, groups, 0).groupBy("group_no").applyInPandas(first, schema))
    done = capacity * (1 - NEARLY_FULL)
    opened = placed.filter((F.col("fill") < done) & (F.col(offset) == 0)).select(F.col(sequence).alias("bin"), "fill")
    moves = None
    n_open, round_no = opened.count(), 0
    while n_open > 1 and groups > 1:
        round_no += 1
        groups = min(groups - 1, -(-n_open // GROUP_ITEMS))

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            bins, offsets = best_fit(rows["fill"].to_numpy(), capacity)
            into = np.zeros(bins.max() + 1, np.int64)
            into[bins[offsets == 0]] = rows["bin"].to_numpy()[offsets == 0]
            fill = np.bincount(bins, weights=rows["fill"]).astype(np.int64)
            return pd.DataFrame({"bin": rows["bin"], "into": into[bins], "shift": offsets, "into_fill": fill[bins]})

        step = cut_lineage(dealt(opened, groups, round_no).groupBy("group_no").applyInPandas(merge, "bin long, into long, shift long, into_fill long"))
        moved = step.select("bin", "into", "shift")
        if moves is None:
            moves = moved
        else:
            later = moved.select(F.col("bin").alias("into"), F.col("into").alias("further"), F.col("shift").alias("more"))
            moves = moves.join(later, "into", "left").select("bin", F.coalesce("further", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        opened = step.filter((F.col("into_fill") < done) & (F.col("shift") == 0)).select("bin", F.col("into_fill").alias("fill"))
        before, n_open = n_open, opened.count()
        if n_open > before * (1 - LEAST_GAIN):
            break
    if moves is None:
        return placed.drop("fill")
    out = placed.join(moves.withColumnRenamed("bin", sequence), sequence, "left")
    kept = [F.col(c) for c in items.columns]
    return out.select(*kept, F.coalesce("into", sequence).alias(sequence), (F.col(offset) + F.coalesce("shift", F.lit(0))).alias(offset))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset each one is packed at."""
    return pack(cut_lineage(pieces(docs, tokenizer, capacity, id_col, text)), capacity)
