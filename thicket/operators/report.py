"""A scorecard of any clustering over a complete pair frame, and comparison of scorecards.

All figures come from shared frames: counts of equal distances inside and between clusters, distances from each item to
each cluster, the medoids, and distances to the nearest medoid.  What isn't defined is NaN.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property
from types import MappingProxyType
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NAN, ClusterEngineError, PairFrame, exact_mean, members_of
from ..sources.staging import staged
from . import packed

#: Thresholds of the three presets.
PRESETS: dict[str, dict[str, Any]] = {
    "default": {"boundary_threshold": 0.30, "coverage_thresholds": (0.25, 0.35, 0.45)},
    "tight": {"boundary_threshold": 0.25, "coverage_thresholds": (0.20, 0.30, 0.40)},
    "diversity": {"boundary_threshold": 0.40, "coverage_thresholds": (0.40, 0.50, 0.60)},
}
SCALARS = (
    "num_samples",
    "num_clusters",
    "num_noise",
    "num_singletons",
    "noise_fraction",
    "largest_cluster_fraction",
    "singleton_fraction",
    "cluster_size_median",
    "cluster_size_p90",
    "size_gini",
    "size_entropy",
    "mean_intra_distance",
    "median_intra_distance",
    "median_radius",
    "p95_diameter",
    "boundary_violations",
    "silhouette",
    "dunn_index",
    "median_medoid_member_distance",
    "representative_redundancy",
)


def nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


@dataclass(frozen=True)
class Options:
    boundary_threshold: float
    coverage_thresholds: tuple[float, ...]
    representative_method: str = "medoid"
    treat_noise_as_singletons: bool = True


def options(preset: str = "default", **overrides: Any) -> Options:
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    if unknown := set(overrides) - {"boundary_threshold", "coverage_thresholds", "representative_method", "treat_noise_as_singletons"}:
        raise TypeError(f"unknown options {sorted(unknown)}")
    found = PRESETS[preset] | {k: v for k, v in overrides.items() if v is not None}
    found["coverage_thresholds"] = tuple(float(x) for x in found["coverage_thresholds"])
    o = Options(**found)
    if o.boundary_threshold < 0 or any(x < 0 for x in o.coverage_thresholds):
        raise ValueError("a threshold is negative")
    if o.representative_method not in ("medoid", "minimax", "weighted"):
        raise ValueError(f"representative_method {o.representative_method!r} can't be used here")
    return o


def sizes(assignments: DataFrame) -> DataFrame:
    """(label, size) without noise."""
    return assignments.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def profile(assignments: DataFrame, treat_noise_as_singletons: bool = True) -> DataFrame:
    """One row of counts, fractions and the shape of the size distribution."""
    s = sizes(assignments)
    counts = assignments.agg(F.count(F.lit(1)).alias("num_samples"), F.count_if(F.col("label") < 0).alias("num_noise"))
    # clusters of equal size share their ranks; there are at most sqrt(2 * items) different sizes
    by_size = s.groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_size.withColumn("_ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    many = s.agg(F.percentile("size", F.lit(0.5)).alias("cluster_size_median"), F.percentile("size", F.lit(0.9)).alias("cluster_size_p90"))
    shape = ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("num_clusters"),
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("c"))), F.lit(0)).alias("num_singletons"),
        F.max("size").alias("_largest"),
        F.sum(F.col("c") * F.col("size")).alias("_total"),
        F.sum(F.col("_ranks") * F.col("size")).alias("_weighted"),
        F.sum(F.col("c") * F.col("size") * F.log2("size")).alias("_slog"),
    )
    shape = _beside(shape, many)
    both = counts.withColumn("_one", F.lit(1)).join(shape.withColumn("_one", F.lit(1)), "_one")
    n, k, t = F.col("num_samples"), F.col("num_clusters"), F.col("_total")
    singles = F.col("num_singletons") + (F.col("num_noise") if treat_noise_as_singletons else F.lit(0))
    groups = k + (F.col("num_noise") if treat_noise_as_singletons else F.lit(0))
    return both.select(
        "num_samples",
        "num_clusters",
        "num_noise",
        "num_singletons",
        F.when(n == 0, 0.0).otherwise(F.col("num_noise") / n).alias("noise_fraction"),
        F.when((n == 0) | (k == 0), 0.0).otherwise(F.col("_largest") / n).alias("largest_cluster_fraction"),
        F.when(groups == 0, 0.0).otherwise(singles / groups).alias("singleton_fraction"),
        nan(F.col("cluster_size_median")).alias("cluster_size_median"),
        nan(F.col("cluster_size_p90")).alias("cluster_size_p90"),
        F.when(k <= 1, 0.0).otherwise(2 * F.col("_weighted") / (k * t) - (k + 1) / k).alias("size_gini"),
        F.when(k == 0, 0.0).otherwise(F.log2(t) - F.col("_slog") / t).alias("size_entropy"),
    )


@dataclass(frozen=True)
class Frames:
    """What the figures are drawn from, each worked out when it is first asked for.  Distances of pairs come as counts
    of equal ones; fingerprints are paired in the tasks that count, so that no pair is written."""

    pairs: PairFrame
    members: DataFrame  # label, pos, idx
    method: str = "medoid"
    metadata: DataFrame | None = None

    @cached_property
    def _packed(self) -> tuple[Any, np.ndarray, np.ndarray] | None:
        """The fingerprints, and idx and label of the members; None if an item is in two clusters."""
        if self.pairs.source is None:
            return None
        found = self.members.select("idx", F.col("label").cast("int")).toArrow()
        idx, label = (found.column(k).to_numpy() for k in range(2))
        return None if len(np.unique(idx)) < len(idx) else (self.pairs.source, idx, label)

    @cached_property
    def _labelled(self) -> DataFrame:
        lab = self.members.select("idx", "label")
        return self.pairs.df.join(lab.toDF("i", "la"), "i").join(lab.toDF("j", "lb"), "j")

    @cached_property
    def spread(self) -> DataFrame:
        """(label, d, c): how many pairs inside each cluster are d apart; those between clusters have no label."""
        if self._packed:
            return staged(packed.spread(self.members.sparkSession, *self._packed), "spread")
        label = F.when(F.col("la") == F.col("lb"), F.col("la")).alias("label")
        return staged(self._labelled.groupBy(label, "d").agg(F.count(F.lit(1)).alias("c")), "spread")

    @cached_property
    def to_cluster(self) -> DataFrame:
        """(idx, own, other, mean, mx, n): from each item to the other members of each cluster."""
        if self._packed:
            return staged(packed.to_cluster(self.members.sparkSession, *self._packed), "to-cluster")
        x = self._labelled
        both = x.select(F.col("i").alias("idx"), F.col("la").alias("own"), F.col("lb").alias("other"), "d").union(x.select("j", "lb", "la", "d"))
        return staged(both.groupBy("idx", "own", "other").agg(exact_mean(F.col("d")).alias("mean"), F.max("d").alias("mx"), F.count(F.lit(1)).alias("n")), "to-cluster")

    @cached_property
    def medoids(self) -> DataFrame:
        """(label, idx, mean, mx)"""
        own = self.to_cluster.where("own = other").select("idx", F.col("own").alias("label"), "mean", "mx")
        every = self.members.join(own, ["label", "idx"], "left").select("label", "pos", "idx", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("mx", F.lit(0.0)).alias("mx"))
        if self.method == "weighted" and self.metadata is not None:
            every = every.join(self.metadata, "idx", "left")
            score = F.col("mean") + F.coalesce("liability", F.lit(0.0)) - F.coalesce("priority", F.lit(0.0))
        else:
            score = F.col("mx" if self.method == "minimax" else "mean")
        best = every.groupBy("label").agg(F.min_by(F.struct("idx", "mean", "mx"), F.struct(score, F.col("pos"))).alias("b"))
        return staged(best.select("label", "b.*"), "medoids")

    @cached_property
    def to_medoid(self) -> DataFrame:
        """(i, d): from each item to the nearest medoid other than itself."""
        if self._packed:
            centres = np.unique(self.medoids.select("idx").toArrow().column(0).to_numpy())
            return staged(packed.to_nearest(self.members.sparkSession, self._packed[0], centres), "to-medoid")
        near = self.pairs.symmetric().join(self.medoids.select(F.col("idx").alias("j")), "j", "left_semi")
        return staged(near.groupBy("i").agg(F.min("d").alias("d")), "to-medoid")


def frames(assignments: DataFrame, pairs: PairFrame, method: str = "medoid", members: DataFrame | None = None, metadata: DataFrame | None = None) -> Frames:
    if not pairs.complete:
        raise ClusterEngineError("a report needs every pair")
    pairs.require()
    m = staged(members_of(assignments) if members is None else members, "members")
    if pairs.source is None:
        pairs = replace(pairs, df=staged(pairs.df.select("i", "j", "d"), "pairs"))
    return Frames(pairs, m, method, metadata)


def compactness(f: Frames) -> DataFrame:
    """mean/median intra distance, median radius, p95 diameter, median medoid-member distance."""
    intra = f.spread.where("label is not null")
    a = intra.agg(nan(F.sum(F.col("d") * F.col("c")) / F.sum("c")).alias("mean_intra_distance"), nan(F.percentile("d", F.lit(0.5), F.col("c"))).alias("median_intra_distance"))
    labels = f.members.select("label").distinct()
    diameters = labels.join(intra.groupBy("label").agg(F.max("d").alias("dia")), "label", "left")
    b = diameters.agg(nan(F.percentile(F.coalesce("dia", F.lit(0.0)), F.lit(0.95))).alias("p95_diameter"))
    c = f.medoids.agg(nan(F.percentile("mx", F.lit(0.5))).alias("median_radius"), nan(F.percentile("mean", F.lit(0.5))).alias("median_medoid_member_distance"))
    return _beside(a, b, c)


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row frames next to each other."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def silhouette(f: Frames) -> DataFrame:
    a = f.to_cluster.where("own = other").select("idx", "own", F.col("mean").alias("a"))
    b = f.to_cluster.where("own <> other").groupBy("idx", F.col("own").alias("label")).agg(F.min("mean").alias("b"))
    both = f.members.join(a.withColumnRenamed("own", "label"), ["idx", "label"], "left").join(b, ["idx", "label"], "left")
    both = both.withColumn("a", F.coalesce("a", F.lit(0.0)))
    s = F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    # with fewer than two clusters b is missing for every item
    return both.agg(nan(F.avg(F.when(F.col("b").isNotNull(), s))).alias("silhouette"))


def dunn(f: Frames) -> DataFrame:
    d = f.spread.agg(F.min(F.when(F.col("label").isNull(), F.col("d"))).alias("apart"), F.max(F.when(F.col("label").isNotNull(), F.col("d"))).alias("wide"))
    return d.select(nan(F.when(F.col("wide") > 0, F.col("apart") / F.col("wide"))).alias("dunn_index"))


def boundary(f: Frames, threshold: float) -> DataFrame:
    near = F.when(F.col("label").isNull() & (F.col("d") <= threshold), F.col("c"))
    return f.spread.agg(F.coalesce(F.sum(near), F.lit(0)).alias("boundary_violations"))


def redundancy(f: Frames) -> DataFrame:
    near = f.to_medoid.join(f.medoids.select(F.col("idx").alias("i")).distinct(), "i", "left_semi")
    return near.agg(nan(F.percentile("d", F.lit(0.5))).alias("representative_redundancy"))


def coverage(f: Frames, thresholds: tuple[float, ...]) -> DataFrame:
    """coverage_at (array): share of all items within each threshold of a medoid; empty without clusters."""
    items, near = f.pairs.items(), f.to_medoid
    own = f.medoids.select("idx", F.lit(0.0).alias("zero"))
    every = items.join(near, items.idx == near.i, "left").join(own, "idx", "left").select(F.coalesce("zero", "d").alias("d"))
    one = every.agg(*[F.avg(F.when(F.col("d") <= t, 1.0).otherwise(0.0)).alias(f"c{k}") for k, t in enumerate(thresholds)], F.count("d").alias("known"))
    some = F.array(*[F.col(f"c{k}") for k in range(len(thresholds))]) if thresholds else F.array().cast("array<double>")
    return one.select(F.when(F.col("known") > 0, some).otherwise(F.array().cast("array<double>")).alias("coverage_at"))


def report(assignments: DataFrame, pairs: PairFrame, preset: str = "default", members: DataFrame | None = None, metadata: DataFrame | None = None, **overrides: Any) -> DataFrame:
    """One row: the SCALARS, coverage_thresholds and coverage_at."""
    o = options(preset, **overrides)
    f = frames(assignments, pairs, o.representative_method, members, metadata)
    row = _beside(
        profile(assignments, o.treat_noise_as_singletons), compactness(f), silhouette(f), dunn(f), boundary(f, o.boundary_threshold), redundancy(f), coverage(f, o.coverage_thresholds)
    )
    return row.withColumn("coverage_thresholds", F.array(*map(F.lit, o.coverage_thresholds))).select(*SCALARS, "coverage_thresholds", "coverage_at")


@dataclass(frozen=True)
class Card:
    """A report's figures as attributes that can't be set; `row` is the report."""

    row: DataFrame
    values: Mapping[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def to_dict(self) -> dict[str, Any]:
        return dict(self.values)


def card(row: DataFrame) -> Card:
    """The one row of a report as an object to read from."""
    found = row.first().asDict()
    found = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items()}
    return Card(row, MappingProxyType(found))


def to_table(row: DataFrame, name: str) -> DataFrame:
    """(metric, <name>) of a report: the scalars, then coverage_at[t]."""
    flat = row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, SCALARS)), F.array(*[F.col(c).cast("double") for c in SCALARS]))).alias("metric", name))
    cover = row.select(F.explode(F.arrays_zip("coverage_thresholds", "coverage_at")).alias("z")).select(F.format_string("coverage_at[%s]", F.col("z.coverage_thresholds").cast("string")), F.col("z.coverage_at"))
    return flat.union(cover)


def compare(reports: dict[str, DataFrame]) -> DataFrame:
    """(metric, one column for each report) over the union of metrics; NaN where a report lacks one."""
    if len(reports) < 2:
        raise ValueError("comparing takes two reports or more")
    names = list(reports)
    out = to_table(reports[names[0]], names[0])
    for name in names[1:]:
        out = out.join(to_table(reports[name], name), "metric", "full")
    return out.select("metric", *[nan(F.col(n)).alias(n) for n in names])


def to_text(table: DataFrame) -> str:
    """The comparison as aligned text, scalars in their order, then coverage."""
    order = {m: k for k, m in enumerate(SCALARS)}
    rows = sorted(table.collect(), key=lambda r: (order.get(r["metric"], len(order)), r["metric"]))
    names = table.columns[1:]
    width = max([len(r["metric"]) for r in rows] + [6])
    lines = ["metric".ljust(width) + "".join(n.rjust(16) for n in names)]
    lines += [r["metric"].ljust(width) + "".join(f"{r[n]:.4g}".rjust(16) for n in names) for r in rows]
    return "\n".join(lines)
