"""Token counts (operator 3), and the words' token ids that the packing uses.

Method: pieces are counted once per distinct pre-token and joined to the pre-token
frequencies of each document; no document is ever encoded as a whole and no ids are kept.

The table of distinct pre-tokens belongs to a task: it is filled from the task's own
documents, holds at most ``KEPT`` pre-tokens and carries on from batch to batch. A table for
the whole corpus would have to shuffle every (block, pre-token) pair to the table and back;
see the README for the figures that speak against it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from careloom.llm.text import as_texts, slices, split_words

#: Pre-tokens that a task remembers: half of them seen lately, half before that; forgetting costs time only.
KEPT = 300_000
#: Longer pre-tokens are encoded each time they occur in a batch and not remembered.
LONGEST_KEPT = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def word_model(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered:
    """Values per pre-token, worked out by ``make`` for those not seen lately.

    Two generations: what is used moves to the young one, and when that is full the old one is dropped, so
    that frequent pre-tokens stay.
    """

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def __call__(self, words: list[str]) -> list:
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        for i in [i for i, v in enumerate(out) if v is None]:
            w = words[i]
            v = out[i] = old.get(w)
            if v is not None:
                young[w] = v
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            for i, v in zip(new, self.make([words[i] for i in new]), strict=True):
                out[i] = v
                if len(words[i]) <= LONGEST_KEPT:
                    young[words[i]] = v
        if len(young) > KEPT // 2:
            self.young, self.old = {}, young
        return out


def check_word_bound(model) -> None:
    """Splitting before spaces is exact only if no piece goes on after another character."""
    for i in range(model.get_piece_size()):
        if re.search("[^▁]▁", model.id_to_piece(i)):
            raise ValueError(f"piece {i} spans a word bound; this vocabulary can't be counted by words")


def piece_counter(path: str):
    model = piece_model(path)
    check_word_bound(model)
    # a lone space at the end is a piece of its own, while an empty text has none
    empty = len(model.encode("a ")) - len(model.encode("a"))
    return Remembered(lambda words: [len(x) if w else empty for w, x in zip(words, model.encode(words, num_threads=1), strict=True)])


#: Texts whose spaces don't just part words.
ODD_SPACES = "  |^ | $|▁"


def piece_counts(texts: pa.Array, counter: Remembered) -> np.ndarray:
    """Pieces of every text: frequencies of its pre-tokens times their counts."""
    words = split_words(texts, None)
    total = np.zeros(len(texts))
    odd = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False)
    if len(words.distinct):
        counts = np.array(counter(words.distinct.to_pylist()), dtype=np.float64)
        total = np.bincount(words.row, weights=counts[words.index], minlength=len(texts))
    for i in np.flatnonzero(odd):
        own = [p[1:] for p in re.findall("[ ▁]+[^ ▁]*", " " + texts[int(i)].as_py())]
        distinct, freq = np.unique(np.array(own, dtype=object), return_counts=True)
        total[i] = np.dot(counter(distinct.tolist()), freq)
    return total.astype(np.int64)


def count_tokens(docs: DataFrame, model: str, text: str = "text", into: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the number of bytes and of tokens of every whole text.

    A null text counts as an empty one and has no tokens. Rows are taken as they come:
    repeated rows, null ids and further columns pass through; columns named like the two
    results are replaced. No row is moved between tasks.
    """
    kept = docs.drop(into, n_bytes)
    schema = StructType([*kept.schema.fields, StructField(n_bytes, LongType()), StructField(into, LongType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                texts = as_texts(batch.column(at))
                sizes = pc.binary_length(texts).cast(pa.int64())
                columns = [*batch.columns, sizes, pa.array(piece_counts(texts, counter))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, n_bytes, into])

    return kept.mapInArrow(run, schema)


#: Words that fall into parts without asking the tokenizer: ASCII and Latin-1 letters, digits and
#: marks. The apostrophe (contractions) and ``<`` (special tokens) are left to it.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]*")
#: Classes of bytes; a letter beyond ASCII is a lead byte and the one behind it.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def byte_classes() -> np.ndarray:
    out = np.full(256, ODD, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else ODD if c in "'<" else MARK
    out[0x20] = SPACE
    return out


CLASSES = byte_classes()


def in_parts(texts: pa.Array) -> pa.Array:
    """The texts with plain words lower-cased and their parts set off by spaces.

    This vocabulary lower-cases and parts letters, digits and marks from each other, so the ids of a plain word
    are those of its parts. A word with any other character stays as it is.
    """
    if not len(texts):
        return texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(body):
        return texts
    kind = CLASSES[body]
    lead = np.flatnonzero(body == 0xC3)  # U+00C0 to U+00FF; the product and division signs are no letters
    low = body[lead + 1]
    letter = lead[(low != 0x97) & (low != 0xB7)]
    kind[letter] = kind[letter + 1] = LETTER
    first = np.zeros(len(body), bool)
    first[at[:-1][at[:-1] < len(body)]] = True
    space = kind == SPACE
    first[1:] |= space[1:] | space[:-1]
    first[0] = True
    word = np.cumsum(first, dtype=np.int32) - 1
    odd = np.zeros(int(word[-1]) + 1, bool)
    odd[word[kind == ODD]] = True
    plain = ~odd[word]
    upper = plain & (((body >= 0x41) & (body <= 0x5A)))
    behind = letter + 1
    upper[behind[plain[behind] & (body[behind] <= 0x9E)]] = True
    lower = body + (upper.astype(np.uint8) << 5)
    cut = np.zeros(len(body), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut &= plain & ~first
    moved = np.cumsum(cut)
    out = np.full(len(body) + int(moved[-1]), 0x20, np.uint8)
    out[np.arange(len(body)) + moved] = lower
    at = at + np.concatenate([[0], moved])[at]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(out))


def word_ids(path: str) -> Remembered:
    """Little-endian 32-bit ids of the strings between the spaces of :func:`in_parts`."""
    model = word_model(path)
    last = np.zeros(model.get_vocab_size(), bool)  # ids that end a word
    last[[i for w, i in model.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(parts: list[str]) -> list[bytes]:
        texts = [" ".join(parts[i: i + 512]) for i in range(0, len(parts), 512)]  # each part is one pre-token
        out = []
        for coded in model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(coded.ids, dtype="<u4")
            ends = ((np.flatnonzero(last[ids]) + 1) * 4).tolist()
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(out) != len(parts):
            raise ValueError("parts and words of the tokenizer differ")
        return out

    def make(words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
        for i, ids in zip(plain, encode([words[i] for i in plain]), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, coded in zip(rest, model.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(coded.ids, dtype="<u4").tobytes()
        return out

    return Remembered(make)


def text_ids(texts: pa.Array, coder: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, end to end, and where each text's begin; the last entry is their end.

    Spaces and line ends always part tokens in this vocabulary.
    """
    words = split_words(in_parts(pc.replace_substring(texts, "\n", " ")), None)
    parts = coder(words.distinct.to_pylist())
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), dtype="<u4")
    starts = np.cumsum(lengths) - lengths
    n = lengths[words.index]
    ends = np.concatenate([[0], np.cumsum(n)])
    pick = np.arange(int(ends[-1])) + np.repeat(starts[words.index] - ends[:-1], n)
    return flat[pick], ends[words.bounds]
