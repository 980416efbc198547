"""Word splitting over Arrow columns, shared by the operators on texts.

A column of texts becomes three arrays: the distinct words, the index of every word among
them and the row each word stands in. All of it is Arrow or numpy work; Python touches a
word only once per batch, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes of a word that is hashed eight bytes at a time, beside others; longer ones are rare.
LONG_WORD = 64


def byte_table(separators: str, lower: bool = True) -> bytes:
    """Maps A-Z to a-z and every separator byte to a space; bytes from 0x80 stay."""
    table = bytearray(range(256))
    for upper in range(0x41, 0x5B) if lower else ():
        table[upper] = upper + 0x20
    for byte in separators.encode():
        table[byte] = 0x20
    return bytes(table)


#: Words are runs of anything but white space.
SPACED = byte_table(" \t\n\x0b\x0c\r")
#: The same with capitals kept.
CASED = byte_table(" \t\n\x0b\x0c\r", lower=False)
#: Words are runs of a-z, 0-9 and everything outside ASCII.
ALNUM = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


@dataclass
class Words:
    distinct: pa.Array
    index: np.ndarray
    row: np.ndarray
    rows: int
    #: Hashes of the distinct words, once they are known.
    each: np.ndarray | None = None

    @property
    def bounds(self) -> np.ndarray:
        """Where each row's words begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, computed once per distinct word."""
        if self.each is None:
            self.each = word_hashes(self.distinct)
        return self.each[self.index]


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null texts are empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with every byte mapped; the table must keep bytes from 0x80."""
    if not len(texts):
        return texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = bytes(memoryview(data)[at[0]: at[-1]]).translate(table) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(body))


def split_words(texts: pa.Array, table: bytes | None) -> Words:
    """Words between spaces, after mapping the bytes; without a table the texts stay as they are."""
    n = len(texts)
    lists = pc.split_pattern(translated(texts, table) if table else texts, " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(n, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), row[full.to_numpy(zero_copy_only=False)], n)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into row ranges of about ``limit`` text bytes each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    start = 0
    for stop in [*(np.flatnonzero(np.diff(part)) + 1), len(size)]:
        if stop > start:
            yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that minima over them are unbiased."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every text, by its bytes alone: eight at a time, of all texts at once."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    start, length = at[:-1] - at[0], np.diff(at)
    body = words.buffers()[2]
    data = (bytes(memoryview(body)[at[0]: at[-1]]) if body is not None else b"") + bytes(8)
    out = length.astype(np.uint64)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    left, done = np.flatnonzero(length <= LONG_WORD), 0
    with np.errstate(over="ignore"):
        while len(left):
            part = eight[start[left] + done] & masks[np.minimum(length[left] - done, 8)]
            out[left] = mixed(out[left] * np.uint64(0x9E3779B97F4A7C15) + part)
            done += 8
            left = left[length[left] > done]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at every position but the last ``n - 1``."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i: i + count]
    return mixed(out)
