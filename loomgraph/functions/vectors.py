"""Vectors as arrays of doubles."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import TOKEN, col

_TOKEN = re.compile(TOKEN)


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter length, as a zip does."""
    a, b = col(a), col(b)
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    lengths = lambda v: F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return dot(a, b) / (lengths(a) * lengths(b))


class Slots(dict):
    """Slot of each token for a size, MD5 as a number modulo the size, and that plus the size where bit 8 is not set (its sign). Memory is bounded."""

    def __init__(self, dim: int, most: int = 200_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest())
        found = self[token] = h % self.dim + (0 if h >> 8 & 1 else self.dim)
        return found


@lru_cache(maxsize=4)
def _slots(dim: int) -> Slots:
    """One for each Python worker and size."""
    return Slots(dim)


def hash_vector(lowered: str, dim: int) -> np.ndarray:
    """Signed token counts by slot, scaled to length 1; all zero without tokens."""
    counts = np.bincount(np.fromiter(map(_slots(dim).__getitem__, _TOKEN.findall(lowered)), np.int64), minlength=2 * dim)
    out = (counts[:dim] - counts[dim:]).astype(float)
    return out / (np.sqrt(out @ out) or 1.0)


def hash_embedding(text: Column | str, dim: int) -> Column:
    """Signed token counts by hash slot, scaled to length 1 (all zero without tokens); dim 0 means 256, null stays null.

    One Arrow function of the row, so nothing is shuffled.
    """
    dim = dim if dim and dim > 0 else 256

    @F.arrow_udf("array<double>")
    def run(lowered: pa.Array) -> pa.Array:
        rows = [None if t is None else hash_vector(t, dim) for t in lowered.to_pylist()]
        flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0)])
        ends = np.cumsum([0, *(dim * (r is not None) for r in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([r is None for r in rows], pa.bool_()))

    return run(F.lower(col(text)))


def hash_embed(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key and embedding of each row; null text counts as empty."""
    return rows.select(key, hash_embedding(F.coalesce(text, F.lit("")), dim).alias("embedding"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The element-wise mean of each key's vectors; rows without a vector do not count, keys without any are left out."""
    cells = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select(key, F.transform("p", lambda s: s["m"]).alias("embedding"))
