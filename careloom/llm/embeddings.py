"""Near-duplicate embeddings by spherical-cap filters (operator 6).

Method: filter directions form random product codes: after a random rotation a vector is cut
into two blocks, each with its own list of random unit codewords, and every pair of codewords
is a direction. A vector is list-decoded to all directions whose inner product with it exceeds
the cap height; vectors meet on directions, and every meeting is verified by its cosine. Directions of
one code depend on each other, so there are ``CODES`` codes with a rotation each.

The cap height follows the number of vectors, so that a direction holds few unrelated ones,
and the code is as large as it must be for a pair at the threshold to share ``EXPECTED``
directions on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.llm.banding import numbered, shared_counts, spanning
from careloom.llm.graph import components
from careloom.session import cut_lineage

#: Directions that a pair at the threshold shares on average.
EXPECTED = 24
#: Independent codes that the directions are spread over.
CODES = 32
#: Unrelated vectors that share one direction with a vector on average.
LOAD = 0.05
#: Vectors of a block; two blocks are compared in a task.
BLOCK = 192
#: Rows of small directions that one group gets, about.
GROUP_ROWS = 2048


def block_density(dims: int, points: np.ndarray) -> np.ndarray:
    """Density of one coordinate of a random unit vector, on evenly spaced points."""
    if dims < 2:
        density = (np.abs(points) > points.max() - 1e-9).astype(float)
    else:
        density = np.maximum(1 - points * points, 1e-12) ** ((dims - 3) / 2)
    return density / density.sum()


@dataclass(frozen=True)
class Code:
    """Product codes for vectors of ``dims`` numbers, with ``words`` codewords to a block."""

    dims: int
    words: int
    height: float

    @property
    def cuts(self) -> list[int]:
        return [0, self.dims // 2, self.dims] if self.dims >= 4 else [0, self.dims]

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Numbers of the directions that each unit vector exceeds, in ascending order."""
        found: list[list[np.ndarray]] = [[] for _ in vectors]
        for code, (rotation, books) in enumerate(code_parts(self)):
            turned = vectors @ rotation
            scores = [turned[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], books, strict=False)]
            first = code * self.words ** len(books)
            if len(books) == 1:
                for out, s in zip(found, scores[0], strict=True):
                    out.append(first + np.flatnonzero(s >= self.height))
                continue
            need = self.height * np.sqrt(2)
            tops = [x.max(axis=1) for x in scores]
            for r in np.flatnonzero(tops[0] + tops[1] >= need):
                s, t = scores[0][r], scores[1][r]
                i, j = np.flatnonzero(s >= need - tops[1][r]), np.flatnonzero(t >= need - tops[0][r])
                a, b = np.nonzero(s[i][:, None] + t[j][None, :] >= need)
                found[r].append(first + np.sort(i[a] * self.words + j[b]))
        return [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found]


@lru_cache(maxsize=2)
def code_parts(code: Code) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    rng = np.random.default_rng(code.dims)
    out = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((code.dims, code.dims)))[0]
        books = [rng.standard_normal((code.words, b - a)) for a, b in zip(code.cuts, code.cuts[1:], strict=False)]
        out.append((rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]))
    return out


def code_for(dims: int, vectors: int, cosine: float) -> Code:
    """Cap height and code size for so many vectors, from the law of the scores in a product code."""
    points = np.linspace(-1, 1, 4001)
    if dims >= 4:
        half = np.convolve(block_density(dims // 2, points), block_density(dims - dims // 2, points))
        score, density = np.linspace(-1, 1, len(half)), half  # (t1 + t2) / 2 for blocks of equal norm
    else:
        score, density = points, block_density(dims, points)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    at = int(np.searchsorted(-above, -min(0.05, LOAD / max(vectors, 1) / 2)))
    # with few dimensions the caps stay at least as wide as the threshold is
    at = min(at, int(np.searchsorted(score, cosine)), len(score) - 1)
    height = float(score[at])
    # the other vector's score: the same share of this one's, and an independent rest
    rest = block_density(max(dims - 1, 1), points)
    tail = np.cumsum(rest[::-1])[::-1]
    s, weight = score[at:], density[at:] / density.sum()
    side = np.sqrt(max(1 - cosine * cosine, 1e-12)) * np.sqrt(np.maximum(1 - s * s, 1e-12))
    both = float((weight * np.interp((height - cosine * s) / side, points, tail, left=1.0, right=0.0)).sum())
    size = EXPECTED / CODES / max(both, 1e-12)
    words = int(np.ceil(np.sqrt(size) if dims >= 4 else size))
    return Code(dims, max(words, 8), height)


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty, zero or non-finite ones."""
    out = []
    for value in column.to_pylist():
        v = None
        if value and None not in value:
            x = np.array(value, dtype=np.float64)
            if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top  # so that squares neither overflow nor vanish
                v = x / np.sqrt((x * x).sum())
        out.append(v)
    return out


def classes_of(vectors: DataFrame) -> DataFrame:
    """``id`` and ``key`` of every vector; equal unit vectors have one key, unusable ones none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_vectors(b.column(1))
            raw = [None if u is None else (u + 0.0).tobytes() for u in units]
            keys = [None if r is None else hashlib.md5(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "unit"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, key binary, unit binary")


def decoded(classes: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """Adds the array of directions to ``no, copies, unit``; codes of other lengths never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                b = whole.slice(start, 256)
                units = [np.frombuffer(u, np.float64) for u in b.column(2).to_pylist()]
                dims = np.array([len(u) for u in units])
                found: list = [None] * len(units)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    for i, list_of in zip(at, codes[int(d)].decode(np.stack([units[i] for i in at])), strict=True):
                        found[i] = list_of
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=["no", "copies", "unit", "directions"])

    return classes.mapInArrow(run, "no long, copies long, unit binary, directions array<long>")


def compared(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links inside one direction or between two blocks of it, each in the pair's first direction only.

    Rows ``a, null, n``: vector a has n links. Rows ``a, b, 0``: a link that joins components.
    """
    units = np.stack([np.frombuffer(u, np.float64) for u in rows["unit"]])
    close = np.triu(units @ units.T >= cosine, 1)
    if rows["p"].iloc[0] != rows["q"].iloc[0]:
        block = rows["block"].to_numpy()
        close &= block[:, None] != block[None, :]
    if not close.any():
        return pd.DataFrame({"a": [], "b": [], "n": []})
    here = rows["direction"].iloc[0]
    earlier = [x[x < here] for x in rows["directions"]]
    left, right = np.nonzero(close & (shared_counts(earlier) == 0))
    copies, keys = rows["copies"].to_numpy(), rows["no"].to_numpy()
    n = np.bincount(left, weights=copies[right], minlength=len(keys)) + np.bincount(right, weights=copies[left], minlength=len(keys))
    some, joined = np.flatnonzero(n), spanning(len(keys), left, right)
    counts = pd.DataFrame({"a": keys[some], "b": None, "n": n[some]})
    links = pd.DataFrame({"a": keys[left[joined]], "b": keys[right[joined]], "n": 0})
    return pd.concat([counts, links])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """For every row: id, n_links (other rows linked directly) and component_id.

    Rows are linked where a shared direction brings them together and their cosine is
    ``cosine`` or more; the smallest id of a component names it. Null, empty and zero vectors and
    those with null or non-finite numbers are linked with nothing, as are vectors of different
    length. Equal vectors are one class, linked with each other. A row without id takes part;
    its component has the name of its other rows, or null. Further columns are not read.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    keyed = cut_lineage(classes_of(source))
    classes = numbered(keyed.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    sizes = classes.groupBy((F.octet_length("unit") / 8).cast("int").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()
    codes = {r["dims"]: code_for(r["dims"], r["n"], cosine) for r in sizes}
    total = sum(r["n"] for r in sizes)
    found = cut_lineage(decoded(classes.select("no", "copies", "unit"), codes))
    spread = found.select("no", F.octet_length("unit").alias("bytes"), F.explode("directions").alias("direction"))
    shared = spread.groupBy("bytes", "direction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = spread.join(shared, ["bytes", "direction"]).join(found, "no")
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    # directions of one block share groups by hash; each pair of blocks of a larger one has its own
    groups = max(1, total // GROUP_ROWS * 4)
    met = met.withColumn("g", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("direction"), F.lit(groups))).otherwise(F.xxhash64("bytes", "direction", "p", "q")))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [compared(part, cosine) for _, part in rows.groupby(["bytes", "direction", "p", "q"])]
        return pd.concat(parts).astype({"a": "Int64", "b": "Int64", "n": "int64"})

    links = cut_lineage(met.select("g", "bytes", "direction", "p", "q", "block", "no", "copies", "unit", "directions").groupBy("g").applyInPandas(group, "a long, b long, n long"))
    counted = links.filter("b is null").groupBy(F.col("a").alias("no")).agg(F.sum("n").alias("others"))
    roots = components(links.filter("b is not null")).select(F.col("node").alias("no"), "root")
    named = classes.select("key", "no", "id", "copies").join(roots, "no", "left").join(counted, "no", "left").withColumn("root", F.coalesce("root", "no"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "root").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "key").join(of_class, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
