"""The relation of pairs, results of clusterings, and errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ClusterEngineError(RuntimeError):
    """Data that an operator can't work on, such as incomplete pairs."""


NAN = float("nan")
NOISE = -1
#: Largest number of items for operators that need the whole distance matrix in one task (float64: 3.2 GB).
MATRIX_LIMIT = 20_000


@dataclass(frozen=True)
class PairFrame:
    """Distances or similarities of the pairs i < j of n items, as a DataFrame (i, j, d).

    complete: every pair has a row.  cutoff: rows with d above it were left out.  A missing row of an incomplete frame
    is unknown, not zero.  labels: (idx, label), if items have names.
    """

    df: DataFrame
    n: int
    comparison: str
    kind: str = "distance"
    complete: bool = True
    cutoff: float | None = None
    params: dict[str, Any] = field(default_factory=dict)
    labels: DataFrame | None = None
    #: The fingerprints (operators.packed.Packed) of a frame of all their pairs, or of a cut of it.
    source: Any = None
    #: Makes (i, j, d) with d rounded to so many digits, where that is cheaper than rounding every row.
    rows: Callable[[int], DataFrame] | None = None

    @property
    def num_pairs(self) -> int:
        return self.n * (self.n - 1) // 2

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, self.n

    def __len__(self) -> int:
        return self.n

    def require(self, *, complete: bool = False, threshold: float | None = None) -> None:
        """Raise unless these are distances, complete if asked for, and known up to the threshold."""
        if self.kind != "distance":
            raise ClusterEngineError("clustering needs distances, not similarities")
        if complete and not self.complete:
            raise ClusterEngineError("this needs every pair; the frame was cut off")
        if threshold is not None and self.cutoff is not None and threshold > self.cutoff:
            raise ClusterEngineError(f"threshold {threshold} is above the cutoff {self.cutoff} of the pairs")

    def items(self) -> DataFrame:
        return self.df.sparkSession.range(self.n).withColumnRenamed("id", "idx")

    def symmetric(self) -> DataFrame:
        """(i, j, d) in both directions, without the diagonal."""
        return self.df.select("i", "j", "d").union(self.df.select(F.col("j"), F.col("i"), F.col("d")))

    def squareform(self) -> DataFrame:
        """Both directions and the diagonal, which is 0 for distances and 1 for similarities."""
        own = F.lit(0.0 if self.kind == "distance" else 1.0)
        return self.symmetric().union(self.items().select(F.col("idx"), F.col("idx"), own))

    def condensed(self) -> DataFrame:
        """(k, i, j, d) with the index k of the flat upper triangle."""
        return self.df.withColumn("k", condensed_index(F.col("i"), F.col("j"), self.n)).select("k", "i", "j", "d")

    def within(self, threshold: float) -> DataFrame:
        """Edges (src, dst) of pairs at most `threshold` apart, both directions, without loops."""
        near = self.df.where(F.col("d") <= threshold)
        return near.select(F.col("i").alias("src"), F.col("j").alias("dst")).union(near.select("j", "i"))

    def cut(self, cutoff: float) -> PairFrame:
        """The pairs at most `cutoff` apart; an incomplete frame."""
        if self.kind != "distance":
            raise ValueError("a cutoff keeps small values, so it needs distances")
        if self.source is not None:
            from .operators import packed

            near = packed.pairs(self.df.sparkSession, self.source, cutoff=cutoff if self.cutoff is None else min(cutoff, self.cutoff))
        else:
            near = self.df.where(F.col("d") <= cutoff)
        return PairFrame(near, self.n, self.comparison, self.kind, False, cutoff, self.params, self.labels, self.source)

    def rounded(self, digits: int) -> DataFrame:
        """(i, j, d) with d rounded."""
        if self.rows is not None:
            return self.rows(digits)
        return self.df.select("i", "j", F.round("d", digits).alias("d"))

    def sparse(self, drop_zeros: bool = False) -> DataFrame:
        """The stored rows as coordinates; drop_zeros leaves out exact duplicates, as dense-to-sparse conversions do."""
        return self.df.where("d <> 0") if drop_zeros else self.df

    def to_condensed(self, fill: float = 0.0):
        """The flat upper triangle as a numpy array; pairs without a row get `fill`."""
        import numpy as np

        if self.n > MATRIX_LIMIT:
            raise ClusterEngineError(f"{self.n} items are too many for one array")
        out = np.full(self.num_pairs, fill)
        found = self.condensed().select("k", "d").toArrow()
        out[found.column("k").to_numpy()] = found.column("d").to_numpy()
        return out

    def to_matrix(self, fill: float = 0.0):
        import numpy as np

        m = np.full((self.n, self.n), 0.0 if self.kind == "distance" else 1.0)
        upper = np.triu_indices(self.n, 1)
        m[upper] = self.to_condensed(fill)
        m.T[upper] = m[upper]
        return m


def condensed_index(i, j, n: int):
    """Place of the pair i < j in the flat upper triangle."""
    return F.lit(n).cast("long") * i - F.shiftright(i * (i + 1), 1) + j - i - 1


def exact_mean(d):
    """The mean of the non-null d, the same in any order of the rows: d counts to 18 decimals.  Values that are not
    numbers, or of 1e12 and more, fall back on the plain mean, whose last bit may depend on the order."""
    known = F.when(F.abs(d) < 1e12, d)
    exact = F.sum(known.cast("decimal(30,18)")).cast("double") / F.count(known)
    return F.when(F.count(d) == F.count(known), exact).otherwise(F.avg(d))


def condensed_pair(k: int, n: int) -> tuple[int, int]:
    """The pair at a place of the flat upper triangle."""
    from math import isqrt

    # rows from the end: k' = pairs after this one, i' the largest with i'(i'+1)/2 <= k'
    back = n * (n - 1) // 2 - 1 - k
    row = (isqrt(8 * back + 1) - 1) // 2
    i = n - 2 - row
    return i, k - (n * i - i * (i + 1) // 2) + i + 1


@dataclass(frozen=True)
class Clustering:
    """assignments (idx, label), label -1 for noise; members (label, pos, idx), pos the place inside the cluster."""

    method: str
    n: int
    assignments: DataFrame
    members: DataFrame
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def num_clusters(self) -> int:
        return self.members.select("label").distinct().count()


def members_of(assignments: DataFrame) -> DataFrame:
    """(label, pos, idx) with ascending members, noise left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("idx")
    return assignments.where("label >= 0").select("label", (F.row_number().over(w) - 1).alias("pos"), "idx")


def clusters_from_labels(assignments: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(label, idxs): ascending members of each label; keep_empty also lists unused labels below the largest."""
    found = assignments.where("label >= 0").groupBy("label").agg(F.sort_array(F.collect_list("idx")).alias("idxs"))
    if not keep_empty:
        return found
    top = assignments.agg(F.max("label")).first()[0]
    every = assignments.sparkSession.range(0 if top is None or top < 0 else top + 1).select(F.col("id").cast("int").alias("label"))
    return every.join(found, "label", "left").select("label", F.coalesce("idxs", F.array().cast("array<bigint>")).alias("idxs"))
