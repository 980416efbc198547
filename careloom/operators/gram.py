"""Pairwise moments of many features: blocked Gram matrices, summed map-side and merged in a tree.

Features travel as one array per row. A task keeps one state per block of feature pairs and emits it once;
states are merged pairwise-exactly, so that nulls are left out pair by pair. No expression, row or
column is formed per pair of features before the last step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Features of a block.
BLOCK = 256
#: Bytes of all states of a task; beyond that they are emitted and begun anew.
STATE_BYTES = 128 << 20
#: Partial states that are merged in the first level of the tree.
FAN = 16

_SUMS = ("n", "mean_x", "mean_y", "xx", "yy", "xy")
_NAMES = ["key", "row_block", "column_block", "part", *_SUMS]
_SCHEMA = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("row_block", T.LongType()), T.StructField("column_block", T.LongType()),
    T.StructField("part", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in _SUMS),
])


def _centre(values: np.ndarray) -> np.ndarray:
    """The first value of each column that is not missing; a constant column so has exact zeros."""
    here = ~np.isnan(values)
    first = values[here.argmax(axis=0), np.arange(values.shape[1])]
    return np.where(here.any(axis=0), first, 0.0)


class _State:
    """Sums over the pairs of two feature lists, about the first values seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cx, self.cy = _centre(x), _centre(y)
        self.sums = np.zeros((6, x.shape[1], y.shape[1]))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        here_x, here_y = ~np.isnan(x), ~np.isnan(y)
        a, b = np.where(here_x, x - self.cx, 0.0), np.where(here_y, y - self.cy, 0.0)
        self.sums[5] += a.T @ b
        if here_x.all() and here_y.all():
            self.sums[0] += len(x)
            self.sums[1] += a.sum(axis=0)[:, None]
            self.sums[2] += b.sum(axis=0)
            self.sums[3] += (a * a).sum(axis=0)[:, None]
            self.sums[4] += (b * b).sum(axis=0)
        else:
            p, q = here_x.astype(float), here_y.astype(float)
            for i, (u, v) in enumerate(((p, q), (a, q), (p, b), (a * a, q), (p, b * b))):
                self.sums[i] += u.T @ v

    def moments(self) -> np.ndarray:
        """Number, means and centred sums of each pair."""
        n, sx, sy, sxx, syy, sxy = self.sums
        some = np.maximum(n, 1.0)
        empty = n == 0
        mean_x = np.where(empty, 0.0, self.cx[:, None] + sx / some)
        mean_y = np.where(empty, 0.0, self.cy + sy / some)
        return np.stack([n, mean_x, mean_y, sxx - sx * sx / some, syy - sy * sy / some, sxy - sx * sy / some])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    return np.stack([
        n, a[1] + dx * b[0] / some, a[2] + dy * b[0] / some,
        a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
    ])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (key, row block, column block, part, moments)."""
    whole = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    lists = [pa.array([r[4][i].ravel() for r in rows], pa.list_(pa.float64())) for i in range(6)]
    return pa.RecordBatch.from_arrays([*whole, *lists], names=_NAMES)


def pair_moments(
    rows: DataFrame, width: int, rows_of: Mapping[int, Sequence[int]] | None = None, block: int = BLOCK
) -> DataFrame:
    """Moments of pairs of ``x``'s elements per ``key``, as blocks.

    ``rows`` has a long ``key`` and an array ``x`` of ``width`` doubles. With ``rows_of`` a key pairs its
    listed elements (row block 0) with all; otherwise all are paired, in blocks on and above the diagonal.
    NaN and null elements are missing.
    """
    cuts = [np.arange(lo, min(lo + block, width)) for lo in range(0, width, block)]

    def blocks(key: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        if rows_of is not None:
            listed = np.array(rows_of[key], dtype=np.int64)
            return [(0, j, listed, c) for j, c in enumerate(cuts)]
        return [(i, j, r, c) for i, r in enumerate(cuts) for j, c in enumerate(cuts) if i <= j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int, int], _State] = {}
        size = 0
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py() if part is None else part
            keys = batch.column(0).to_numpy()
            values = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            order = np.argsort(keys, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                own, key = values[at], int(keys[at[0]])
                for i, j, r, c in blocks(key):
                    if (key, i, j) not in states:
                        states[key, i, j] = _State(own[:, r], own[:, c])
                        size += states[key, i, j].sums.nbytes
                    states[key, i, j].add(own[:, r], own[:, c])
                if size > STATE_BYTES and rows_of is not None:
                    yield from emitted(states, part)
                    states, size = {}, 0
        yield from emitted(states, part)

    def emitted(states: dict, part: int) -> Iterator[pa.RecordBatch]:
        for (key, i, j), state in states.items():
            yield _batch([(key, i, j, part, state.moments())])

    partial = rows.select("key", "x", (F.spark_partition_id() % FAN).cast("long").alias("part")).mapInArrow(run, _SCHEMA)
    return _merged(_merged(partial, ["key", "row_block", "column_block", "part"]).withColumn("part", F.lit(0).cast("long")), ["key", "row_block", "column_block"])


def _merged(partial: DataFrame, by: list[str]) -> DataFrame:
    """One state per key: neighbours of a sorted partition are merged as they stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                mark = tuple(batch.column(c)[k].as_py() for c in range(4))
                sums = np.stack([batch.column(4 + c)[k].values.to_numpy() for c in range(6)])
                if mark == last:
                    state = _merge(state, sums)
                else:
                    if last is not None:
                        yield _batch([(*last, state)])
                    last, state = mark, sums
        if last is not None:
            yield _batch([(*last, state)])

    return partial.repartition(*by).sortWithinPartitions("key", "row_block", "column_block", "part").mapInArrow(run, _SCHEMA)


def correlations(moments: DataFrame, width: int, rows_of: Mapping[int, Sequence[int]] | None = None, block: int = BLOCK) -> DataFrame:
    """(key, a, b, correlation) of element numbers; null where a side is constant or no row has both."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("correlation", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, i, j = (batch.column(c)[k].as_py() for c in range(3))
                columns = np.arange(j * block, min((j + 1) * block, width))
                rows = np.array(rows_of[key]) if rows_of is not None else np.arange(i * block, min((i + 1) * block, width))
                xx, yy, xy = (batch.column(4 + c)[k].values.to_numpy().reshape(len(rows), len(columns)) for c in (3, 4, 5))
                flat = (xx <= 0) | (yy <= 0)
                value = np.where(flat, 0.0, xy / np.where(flat, 1.0, np.sqrt(xx) * np.sqrt(yy)))
                a, b = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
                yield entries(key, a, b, value.ravel(), flat.ravel())
                if rows_of is None and i != j:
                    yield entries(key, b, a, value.ravel(), flat.ravel())

    def entries(key: int, a: np.ndarray, b: np.ndarray, value: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), key)), pa.array(a), pa.array(b), pa.array(value, mask=flat)], names=schema.names)

    return moments.mapInArrow(run, schema)
