"""Min-max hashing, banding and verification of sets of hashes, shared by both text deduplications.

Every permutation is evaluated once and gives two signature values, its minimum and its
maximum over the set; each equals that of another set with the sets' Jaccard similarity as
probability. Bands of the signature are keys; sets that share a key collide.

Colliding sets are tied to the smallest set under their key, never to each other, and the
components of these ties are clusters. A cluster is cut into blocks of bounded size, and a
task compares two blocks exactly. A cluster of ``n`` blocks so takes ``n * (n + 1) / 2`` tasks'
worth of work, but no task gets more than two blocks, and no rows are made of pairs of sets:
a task returns at most one link per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.llm.bits import bitmap, maybe_in
from careloom.llm.graph import components
from careloom.llm.text import mixed
from careloom.session import cut_lineage

#: Sets of a block, and hashes of all its sets together.
BLOCK_SETS, BLOCK_HASHES = 160, 200_000
#: Columns of the membership matrix that is multiplied at once.
MATRIX_COLUMNS = 8192
#: Sets that share a hash up to which its pairs are counted one by one; a matrix of rare hashes is nearly all zeros.
FEW_SETS = 12


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of sets laid end to end, none of them empty: one row per set.

    Bands 2i and 2i + 1 are the minima and the maxima of the same ``rows`` permutations.
    """
    factors, terms = permutations(-(-bands // 2) * rows)
    out = np.zeros((len(starts), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i, (f, t) in enumerate(zip(factors, terms, strict=True)):
            values = hashes * f + t
            for odd, reduced in ((0, np.minimum.reduceat(values, starts)), (1, np.maximum.reduceat(values, starts))):
                if (band := i // rows * 2 + odd) < bands:
                    out[:, band] = mixed(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + reduced)
        return mixed(out + np.arange(1, bands + 1, dtype=np.uint64))  # the same key in two bands isn't one key


def digests(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits for every set, whatever the order of its distinct hashes."""
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mixed(hashes + np.uint64(1)), starts)
        other = np.bitwise_xor.reduceat(mixed(hashes + np.uint64(2)), starts)
    both = np.stack([total, other], axis=1).astype("<u8").tobytes()
    return [both[i: i + 16] for i in range(0, len(both), 16)]


def numbered(classes: DataFrame) -> DataFrame:
    """The classes, checkpointed, with a number ``no`` each: graphs of numbers are cheaper than of digests."""
    return cut_lineage(classes).withColumn("no", F.monotonically_increasing_id())


def clusters(sets: DataFrame) -> DataFrame:
    """``no`` and ``cluster`` of all sets that collide with another one; ``sets`` has no and bands.

    The hubs of shared bands come first; a bitmap of them then spares the bands that one set has
    alone, which are nearly all, the way to the join.
    """
    keyed = sets.select("no", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("no").alias("hub"), F.max("no").alias("last")).filter("hub <> last").select("band", "hub")
    hubs = cut_lineage(hubs)
    bits = bitmap(hubs, F.col("band"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = b.column(1)
            no = np.repeat(b.column(0).to_numpy(), bands.value_lengths().to_numpy())
            band = bands.flatten().to_numpy()
            some = maybe_in(bits, band)
            yield pa.RecordBatch.from_arrays([pa.array(no[some]), pa.array(band[some])], names=["no", "band"])

    ties = sets.select("no", "bands").mapInArrow(shared, "no long, band long").join(hubs, "band").filter("no <> hub")
    return components(ties, "no", "hub").select(F.col("node").alias("no"), F.col("root").alias("cluster"))


def blocked(members: DataFrame) -> DataFrame:
    """Adds each set's block and the number of blocks to ``no, cluster, size``."""
    need = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_HASHES))
    blocks = members.groupBy("cluster").agg(need.cast("int").alias("blocks"))
    return members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: pairs of the sets of a rare hash, products of slices of the membership matrix for the rest."""
    n = len(sets)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], np.repeat(np.arange(n), [len(s) for s in sets])[order]
    first = np.flatnonzero(np.diff(value, prepend=~value[:1]))
    times = np.diff(np.append(first, len(value)))
    out = np.zeros((n, n))
    for t in range(2, FEW_SETS + 1):  # a hash of one set shares nothing
        near = row[first[times == t][:, None] + np.arange(t)]
        if len(near):
            pairs = sum(np.bincount(near[:, i] * n + near[:, j], minlength=n * n) for i in range(t) for j in range(i, t))
            out += pairs.reshape(n, n)
    out += np.triu(out, 1).T
    many = np.repeat(times > FEW_SETS, times)
    row, column = row[many], np.repeat(np.cumsum(times > FEW_SETS) - 1, times)[many]
    if not len(row):
        return out
    for start in range(0, int(column[-1]) + 1, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + MATRIX_COLUMNS])
        part = np.zeros((n, min(MATRIX_COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        out += part @ part.T
    return out


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Places of links enough to join what all the links join."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            out.append(i)
    return out


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between sets of a cluster whose Jaccard similarity is at least ``percent`` in 100.

    ``members`` has no, cluster, block, blocks and the sorted set of hashes as bytes. All pairs
    of a cluster are compared, colliding or not, by blocks. Of the links that a pair of blocks
    has, those that join the same sets are returned.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("no", "cluster", "block", "set", other)
    pairs = pairs.select("no", "cluster", "block", "set", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, "<u8") for s in rows["set"]]
        size = np.array([len(s) for s in sets])
        both = shared_counts(sets)
        linked = both * 100 >= percent * (size[:, None] + size[None, :] - both)
        block = rows["block"].to_numpy()
        if rows["p"].iloc[0] != rows["q"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        left, right = np.nonzero(np.triu(linked, 1))
        some = spanning(len(sets), left, right)
        keys = rows["no"].to_numpy()
        return pd.DataFrame({"a": keys[left[some]], "b": keys[right[some]]})

    return pairs.groupBy("cluster", "p", "q").applyInPandas(compare, "a long, b long")


def linked_components(members: DataFrame, percent: int) -> DataFrame:
    """``no`` and ``root`` of every set that is linked with another."""
    links = cut_lineage(verified_links(members, percent))
    return components(links).select(F.col("node").alias("no"), "root")
