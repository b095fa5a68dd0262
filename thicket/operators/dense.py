"""All pairs of vectors, worked out in numpy by products of tiles, in the same order of rows as pairs of fingerprints.

The vectors go to every task (MOST_BYTES at most; beyond, the joins by blocks in `pairs` do the same work).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import packed

#: Vectors that are broadcast.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Vectors:
    x: np.ndarray  # n x size
    metric: str
    similarity: bool

    def __len__(self) -> int:
        return len(self.x)

    def one_by_one(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values of single pairs, summed element by element."""
        x, y = self.x[i], self.x[j]
        total = lambda t: np.cumsum(t, axis=1)[:, -1]
        if self.metric == "euclidean":
            return np.sqrt(total((x - y) * (x - y)))
        both = total(x * x) * total(y * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(both == 0, np.nan, total(x * y) / np.sqrt(both))
        return c if self.similarity else 1.0 - c


def load(items: DataFrame, n: int, column: str, metric: str, size: int, similarity: bool) -> Vectors | None:
    """The items on the driver; None where they are too many, or not all finite numbers, or not numbered 0..n-1."""
    if n * size * 8 > MOST_BYTES or size < 1:
        return None
    found = items.select("idx", column).toArrow().combine_chunks()
    if found.num_rows != n or n == 0 or any(found.column(c).null_count for c in found.column_names):
        return None
    idx, lists = found.column("idx").to_numpy(), found.column(column).combine_chunks()
    order, flat = np.argsort(idx), lists.flatten()
    if not np.array_equal(idx[order], np.arange(n)) or flat.null_count or np.any(np.diff(lists.offsets.to_numpy()) != size):
        return None
    x = flat.to_numpy().astype(float).reshape(n, size)[order]
    # beyond 1e6 the error of a product of tiles would reach the digits that are asked for
    return Vectors(x, metric, similarity) if np.isfinite(x).all() and np.abs(x).max() < 1e6 else None


def pairs(spark: SparkSession, vectors: Vectors, digits: int | None = None) -> DataFrame:
    """(i, j, d) of every pair i < j; digits rounds d.  Where the product of tiles is too coarse, for close vectors and
    values next to a half of the last digit, a pair is worked out by itself."""

    def work(v: Vectors, low: int, high: int) -> Iterator[pa.RecordBatch]:
        squares = np.cumsum(v.x * v.x, axis=1)[:, -1]
        scale = None if digits is None else 10.0**digits
        slack = 0.0 if scale is None else min(0.5, scale * 1e-10 * max(1.0, float(np.sqrt(squares.max()))))
        for r, c in packed.tiles(len(v), low, high):
            d = v.x[r] @ v.x[c].T
            if v.metric == "euclidean":
                both = squares[r, None] + squares[c]
                d = both - 2 * d
                close = d < 1e-4 * both
                d = np.sqrt(np.maximum(d, 0.0))
            else:
                both = squares[r, None] * squares[c]
                close = both == 0
                d /= np.sqrt(np.where(close, 1.0, both))
                if not v.similarity:
                    np.subtract(1.0, d, out=d)
            if scale is not None:
                shifted = d * scale + 0.5
                whole = np.floor(shifted)
                part = shifted - whole
                close |= (part < slack) | (part > 1 - slack)
                d = whole / scale
            a, b = np.nonzero(close)
            if len(a):
                exact = v.one_by_one(a + r.start, b + c.start)
                d[a, b] = exact if digits is None else [packed.rounded(x, digits) for x in exact.tolist()]
            i, j, keep = packed.placed(r, c)
            yield packed.batch(i=i, j=j, d=d.ravel() if keep is None else d[keep])

    return packed.run(spark, vectors, work, "i long, j long, d double", triangle=True)
