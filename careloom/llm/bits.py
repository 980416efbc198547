"""A bitmap of hashed values: of fixed size however many values there are, so that tasks may hold it.

It only ever spares work: a value whose bit is not set was never added; one whose bit is set
goes on to an exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 4 MB, whatever it holds.
BITS = 1 << 25
#: Bits of one row of Spark's bitmap aggregate.
ROW_BITS = 32768


def bitmap(values: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes, gathered as at most ``bits / ROW_BITS`` rows."""
    place = F.pmod(hashed, F.lit(bits))
    rows = values.filter(hashed.isNotNull()).groupBy(F.floor(place / ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(ROW_BITS))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    width = ROW_BITS // 8
    for r in rows.collect():
        out[r["part"] * width: (r["part"] + 1) * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where the hash was certainly not added; takes signed or unsigned 64-bit hashes."""
    at = np.mod(hashes.view(np.int64), np.int64(len(bits) * 8))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def parted(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is certainly not in column ``name`` of ``keys``, and the rest, for an exact join.

    Only the rest, with its texts, has to be shuffled.
    """
    bits = bitmap(keys, F.xxhash64(name))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(bits, h.to_numpy()))

    return rows.filter(~maybe(F.xxhash64(key))), rows.filter(maybe(F.xxhash64(key)))
