"""License scan of documents (operator 12).

Method: ordered signature rules (``signatures.py``). The distinct words of a slice of texts are
matched against the rules' keywords once; only texts that hold all keywords of a rule are
searched by its pattern. A detection goes if it overlaps one of a better rank. Of two of equal rank
one of which contains the other the longer one stays, then that of the earlier rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from careloom.llm.signatures import BASE, CONFIDENCE, Signature, rules
from careloom.llm.text import ALNUM, Words, as_texts, slices, split_words

DETECTION = StructType([
    StructField("label", StringType()), StructField("rank", LongType()), StructField("first_word", LongType()),
    StructField("n_words", LongType()), StructField("words", StringType()),
])
ADDED = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
    StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType()), StructField("detections", ArrayType(DETECTION)),
]
DETECTIONS_ARROW = pa.list_(pa.struct([("label", pa.string()), ("rank", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("words", pa.string())]))


@dataclass(frozen=True)
class Hit:
    """Words ``start`` to ``end`` of a text, and the place of the rule that found them."""

    rule: int
    rank: int
    start: int
    end: int


class Scanner:
    """The rules with their compiled patterns, by keyword."""

    def __init__(self, signatures: Sequence[Signature]):
        self.signatures = list(signatures)
        self.patterns = [re.compile(rf"(?<![^ ])(?:{s.pattern})(?![^ ])") for s in self.signatures]
        self.keywords = {w: i for i, w in enumerate(sorted({w for s in self.signatures for w in s.keywords}))}
        self.needs = [frozenset(self.keywords[w] for w in s.keywords) for s in self.signatures]
        # a rule is looked up by its keyword that the fewest rules share
        shared = np.bincount([k for n in self.needs for k in n], minlength=len(self.keywords))
        self.by_keyword: dict[int, list[int]] = {}
        for i, need in enumerate(self.needs):
            self.by_keyword.setdefault(min(need, key=lambda k: (shared[k], k)), []).append(i)

    def gated(self, present: set[int]) -> list[int]:
        """Rules all of whose keywords are present, in order."""
        return sorted(i for k in present for i in self.by_keyword.get(k, ()) if self.needs[i] <= present)

    def hits(self, words: list[str], tried: Sequence[int]) -> list[Hit]:
        """Every match of the tried rules; matches of one rule don't overlap."""
        text = " ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        out = []
        for i in tried:
            for m in self.patterns[i].finditer(text):
                first, end = np.searchsorted(starts, m.span(), side="left").tolist()
                out.append(Hit(i, self.signatures[i].rank, first, end))
        return out


def suppresses(kept: Hit, h: Hit) -> bool:
    if kept.rank < h.rank:
        return kept.start < h.end and h.start < kept.end
    return (kept.start <= h.start and h.end <= kept.end) or (h.start <= kept.start and kept.end <= h.end)


def resolved(hits: list[Hit]) -> list[Hit]:
    """What is left of overlapping detections, in order of their place.

    The hits kept so far don't overlap across ranks and don't contain each other, so that ordered by
    start they are ordered by end as well, and only a new hit's neighbours can suppress it.
    """
    kept: list[Hit] = []
    starts: list[int] = []
    for h in sorted(hits, key=lambda h: (h.rank, h.start - h.end, h.start, h.rule)):
        at = int(np.searchsorted(starts, h.start, side="left"))
        near = kept[max(at - 1, 0): at + 1]
        if any(suppresses(k, h) for k in near):
            continue
        kept.insert(at, h)
        starts.insert(at, h.start)
    return kept


def base_places(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word place in the row and phrase number of every base phrase, by row and place."""
    number = {w: i for i, w in enumerate(words.distinct.to_pylist())}
    index, row, found = words.index, words.row, []
    for p, (_, phrase) in enumerate(BASE):
        parts = [number.get(w, -1) for w in phrase.split()]
        if min(parts) < 0:
            continue
        at = np.flatnonzero(index[: len(index) - len(parts) + 1] == parts[0])
        for j, part in enumerate(parts[1:], 1):
            at = at[(index[at + j] == part) & (row[at + j] == row[at])]
        found.append(np.stack([at, np.full(len(at), p)]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    at, phrase = both[:, np.argsort(both[0], kind="stable")]
    return row[at], at - words.bounds[row[at]], phrase


def scanned(words: Words, scanner: Scanner) -> list[list]:
    """The added columns of every text."""
    bounds = words.bounds
    base: dict[int, list[tuple[int, int]]] = {}
    for r, at, p in zip(*(x.tolist() for x in base_places(words)), strict=True):
        base.setdefault(r, []).append((at, p))
    key = np.array([scanner.keywords.get(w, -1) for w in words.distinct.to_pylist()], dtype=np.int64)
    at = np.flatnonzero(key[words.index] >= 0) if len(key) else np.zeros(0, np.int64)
    present: dict[int, set[int]] = {}
    for r, k in zip(words.row[at].tolist(), key[words.index[at]].tolist(), strict=True):
        present.setdefault(r, set()).add(k)
    out = []
    for r in range(words.rows):
        places = base.get(r, [])
        base_labels = {BASE[p][0] for _, p in places}
        tried = scanner.gated(present[r]) if r in present else []
        kept, own = [], []
        if tried:
            own = words.distinct.take(pa.array(words.index[bounds[r]: bounds[r + 1]])).to_pylist()
            kept = resolved(scanner.hits(own, tried))
        found = [{"label": scanner.signatures[h.rule].label, "rank": h.rank, "first_word": h.start, "n_words": h.end - h.start, "words": " ".join(own[h.start: h.end])} for h in kept]
        labels = base_labels | {f["label"] for f in found}
        score = max((CONFIDENCE[h.rank] for h in kept), default=0.0)
        out.append([
            int(bounds[r + 1] - bounds[r]), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found,
        ])
    return out


def scan_licenses(docs: DataFrame, text: str = "text", signatures: Sequence[Signature] | None = None) -> DataFrame:
    """``docs`` without the text, with what the scan finds in each whole text.

    ``n_words``; ``n_base``, the places of base phrases, ``first_word`` and ``last_word`` of them (null
    without any) and ``base_labels``; ``labels``, which adds those of the kept detections;
    ``score``, the highest confidence of a kept detection, 0 without one; and the
    ``detections`` themselves with their words. A null or empty text has no words and empty labels.
    Rows are taken as they come: repeated rows, null ids and further columns pass through, columns
    named like a result are replaced, and no row is moved between tasks. Of a text that holds one
    rule's phrase many times, every place is found; matches of one rule don't overlap.
    """
    names = [f.name for f in ADDED]
    kept = docs.drop(*[n for n in names if n != text])
    at = kept.columns.index(text)
    schema = StructType([*(f for i, f in enumerate(kept.schema.fields) if i != at), *ADDED])
    used = tuple(signatures if signatures is not None else rules())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(used)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), DETECTIONS_ARROW]
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                found = scanned(split_words(as_texts(batch.column(at)), ALNUM), scanner)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                columns += [pa.array([row[i] for row in found], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)
