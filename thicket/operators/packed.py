"""All pairs of packed fingerprints, worked out in numpy from the items themselves.

A distance of two fingerprints depends on three counts, so it takes few values: pairs are turned into ranks of a small
table of values, and what is asked of all pairs (nearest items, counts, sums by cluster, a spanning tree) is drawn from
the ranks on the spot.  No pair is shuffled or written.  The items go to every task, 16 bytes each for 64 bits; beyond
MOST_BYTES the joins by blocks in `pairs` do the same work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that are broadcast, and bits of a fingerprint, whose table of values has about twice the square of them.
MOST_BYTES = 256 << 20
MOST_BITS = 512
#: Pairs that one step in a task works out at once, and that one task gets.
STEP = 1 << 18
PER_TASK = 1 << 26
#: Side of the tiles in which rows of pairs come out: neighbouring rows share i, and j goes through the same few values.
TILE = 2048


def rounded(x: float, digits: int) -> float:
    """As Spark rounds: half up, in the decimal digits that name the number."""
    return x if x != x else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def load(items: DataFrame, n: int, metric: str, similarity: bool, n_words: int) -> Packed | None:
    """The items on the driver; None where they are too many or too wide, or aren't numbered 0..n-1."""
    if n * (8 * n_words + 8) > MOST_BYTES or 64 * n_words > MOST_BITS:
        return None
    found = items.select("idx", F.slice("words", 1, n_words).alias("words"), "popcount").toArrow().combine_chunks()
    if found.num_rows != n or any(found.column(c).null_count for c in found.column_names):
        return None
    idx = found.column("idx").to_numpy()
    order = np.argsort(idx)
    flat = found.column("words").combine_chunks().flatten() if n else pa.array([], pa.int64())
    if not np.array_equal(idx[order], np.arange(n)) or len(flat) != n * n_words or flat.null_count:
        return None
    return Packed(flat.to_numpy().view(np.uint64).reshape(n, n_words)[order], found.column("popcount").to_numpy()[order].astype(np.uint16), metric, similarity)


@dataclass(frozen=True)
class Packed:
    words: np.ndarray  # n x words, uint64
    pop: np.ndarray  # n, uint16
    metric: str = "tanimoto"
    similarity: bool = False

    def __len__(self) -> int:
        return len(self.pop)

    @property
    def bits(self) -> int:
        return 64 * self.words.shape[1]

    def of_code(self) -> np.ndarray:
        """The value of every code: common bits * (2 * bits + 1) + the two popcounts' sum."""
        c, s = np.divmod(np.arange((self.bits + 1) * (2 * self.bits + 1)), 2 * self.bits + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.metric == "manhattan":
                return (s - 2 * c).astype(float)
            ratio = 2 * c / s if self.metric == "dice" else c / (s - c).astype(float)
        return np.where(c <= s // 2, ratio if self.similarity else 1.0 - ratio, 0.0)

    @cached_property
    def values(self) -> np.ndarray:
        """The values, ascending, NaN last."""
        return np.unique(self.of_code())

    @cached_property
    def rank(self) -> np.ndarray:
        """The place in `values` of every code."""
        v = self.of_code()
        found = np.searchsorted(self.values, v)
        return np.where(np.isnan(v), len(self.values) - 1, found).astype(np.uint16 if len(self.values) < 65_535 else np.uint32)

    def up_to(self, threshold: float) -> np.ndarray:
        """Of every code, whether its value is at most the threshold."""
        return self.of_code() <= threshold

    def codes(self, rows: slice | np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
        x, y = self.words[rows], self.words[columns]
        common = np.bitwise_count(x[:, :1] & y[:, 0])
        kind = np.uint16 if self.bits == 64 else np.uint32
        out = np.multiply(common, kind(2 * self.bits + 1), dtype=kind)
        for k in range(1, x.shape[1]):
            out += np.multiply(np.bitwise_count(x[:, k : k + 1] & y[:, k]), kind(2 * self.bits + 1), dtype=kind)
        out += self.pop[rows].astype(kind)[:, None]
        out += self.pop[columns].astype(kind)
        return out

    def row(self, words: np.ndarray, pop: int) -> np.ndarray:
        """The codes of one fingerprint with all of these."""
        kind = np.uint16 if self.bits == 64 else np.uint32
        common = np.bitwise_count(self.words[:, 0] & words[0]).astype(kind)
        for k in range(1, len(words)):
            common += np.bitwise_count(self.words[:, k] & words[k])
        common *= kind(2 * self.bits + 1)
        common += self.pop
        common += kind(pop)
        return common

    def only(self, keep: np.ndarray) -> Packed:
        return replace(self, words=self.words[keep], pop=self.pop[keep])

    def steps(self, low: int, high: int, width: int | None = None) -> Iterator[slice]:
        """Rows low..high-1 in parts of about STEP pairs with `width` columns."""
        size = max(1, STEP // max(1, len(self) if width is None else width))
        for a in range(low, high, size):
            yield slice(a, min(high, a + size))


def spans(n: int, tasks: int, triangle: bool) -> list[tuple[int, int]]:
    """Rows 0..n-1 in up to `tasks` runs with about as many pairs each; in a triangle row i has n - 1 - i."""
    share = np.linspace(0, 1, tasks + 1)
    edges = np.round(n * (1 - np.sqrt(1 - share)) if triangle else n * share).astype(int)
    return [(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def run(spark: SparkSession, packed: Packed, work: Callable[[Packed, int, int], Iterator[pa.RecordBatch]], schema: str, triangle: bool = False, tasks: int | None = None, rows: int | None = None) -> DataFrame:
    """work(packed, low, high) over runs of rows, each in a task."""
    n = len(packed) if rows is None else rows
    if tasks is None:
        tasks = max(2 * spark.sparkContext.defaultParallelism, n * len(packed) // (2 if triangle else 1) // PER_TASK)
    parts = spans(n, max(1, min(tasks, n)), triangle)
    shared = spark.sparkContext.broadcast(packed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for k in given.column(0).to_pylist():
                yield from work(shared.value, *parts[k])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(task, schema)


def batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


# --- rows --------------------------------------------------------------------------------------------------------------


def tiles(n: int, low: int, high: int) -> Iterator[tuple[slice, slice]]:
    """The pairs i < j of rows low..high-1, by tiles."""
    side = max(1, (1 << 16) // TILE)
    for b in range(low + 1 - (low + 1) % TILE, n, TILE):
        for a in range(low, min(high, b + TILE), side):
            yield slice(a, min(high, a + side)), slice(max(b, low + 1), min(n, b + TILE))


def placed(r: slice, c: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """i and j of a tile's pairs, and a mask where the tile meets the diagonal."""
    i, j = np.arange(r.start, r.stop), np.arange(c.start, c.stop)
    keep = None if r.stop - 1 < c.start else i[:, None] < j
    i, j = np.repeat(i, len(j)), np.tile(j, len(i))
    return (i, j, None) if keep is None else (i[keep.ravel()], j[keep.ravel()], keep)


def pairs(spark: SparkSession, packed: Packed, digits: int | None = None, cutoff: float | None = None, core: np.ndarray | None = None) -> DataFrame:
    """(i, j, d) of every pair i < j, or of those with d <= cutoff; digits rounds d; core: mutual reachability with
    these core distances."""

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        table, own = p.values, core
        if digits is not None:
            table, own = (None if v is None else np.array([rounded(x, digits) for x in v.tolist()]) for v in (table, own))
        table = table[p.rank]
        near = None if cutoff is None else p.up_to(cutoff)
        for r, c in tiles(len(p), low, high):
            code = p.codes(r, c)
            if near is not None:
                a, b = np.nonzero(near.take(code))
                keep = a + r.start < b + c.start
                a, b = a[keep], b[keep]
                if len(a):
                    yield batch(i=a + r.start, j=b + c.start, d=table[code[a, b]])
                continue
            d = table.take(code)
            if own is not None:
                np.maximum(d, np.maximum(own[r, None], own[c]), out=d)
            i, j, keep = placed(r, c)
            yield batch(i=i, j=j, d=d.ravel() if keep is None else d[keep])

    return run(spark, packed, work, "i long, j long, d double", triangle=True)


# --- what is asked of all pairs ----------------------------------------------------------------------------------------


def nearest(spark: SparkSession, packed: Packed, k: int) -> DataFrame:
    """(idx, rank, neighbour, d): the k nearest other items of each, ties by index."""

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        most, n = min(k, len(p) - 1), len(p)
        if most < 1:
            return
        guess = 0
        out = []
        for r in p.steps(low, high):
            for i, ranks in zip(range(r.start, r.stop), p.rank.take(p.codes(r, slice(0, n))), strict=True):
                ranks[i] = len(p.values)
                near = np.flatnonzero(ranks <= guess)
                if len(near) < most or len(near) == n:  # the guess was low; or so high that it took in the item itself
                    near = np.flatnonzero(ranks <= np.partition(ranks, most - 1)[most - 1])
                near = near[np.argsort(ranks[near], kind="stable")[:most]]
                guess = min(len(p.values) - 1, int(ranks[near[-1]]) * 9 // 8 + 1)
                out.append((i, near, ranks[near]))
        i, near, ranks = (np.array([o[x] for o in out]) for x in range(3))
        yield batch(idx=np.repeat(i, most), rank=np.tile(np.arange(1, most + 1, dtype=np.int32), len(i)), neighbour=near.ravel(), d=p.values[ranks.ravel()])

    return run(spark, packed, work, "idx long, rank int, neighbour long, d double")


def degrees(spark: SparkSession, packed: Packed, threshold: float) -> DataFrame:
    """(idx, count): other items at most `threshold` away."""

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        near = p.up_to(threshold)
        for r in p.steps(low, high):
            found = near.take(p.codes(r, slice(0, len(p))))
            found[np.arange(r.stop - r.start), np.arange(r.start, r.stop)] = False
            yield batch(idx=np.arange(r.start, r.stop), count=np.count_nonzero(found, axis=1))

    return run(spark, packed, work, "idx long, count long")


def links(spark: SparkSession, packed: Packed, threshold: float) -> DataFrame:
    """Edges (src, dst) with the same components as all pairs at most `threshold` apart: each task's stars."""
    from .graph import _forest

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        near = p.up_to(threshold)
        held: list[pa.RecordBatch] = []
        for r, c in tiles(len(p), low, high):
            a, b = np.nonzero(near.take(p.codes(r, c)))
            keep = a + r.start < b + c.start
            held.append(batch(src=b[keep] + c.start, dst=a[keep] + r.start))
            if sum(x.num_rows for x in held[1:]) > 1 << 20:
                held = list(_forest(iter(held)))
        yield from _forest(iter(held))

    return run(spark, packed, work, "src long, dst long", triangle=True, tasks=2 * spark.sparkContext.defaultParallelism)


def by_cluster(packed: Packed, idx: np.ndarray, label: np.ndarray) -> tuple[Packed, np.ndarray, np.ndarray, np.ndarray]:
    """The items of clusters in the order of (label, idx), their idx, and each cluster's label and first place."""
    order = np.lexsort((idx, label))
    idx, label = idx[order], label[order]
    names, first = np.unique(label, return_index=True)
    return packed.only(idx), idx, names, first


def to_cluster(spark: SparkSession, packed: Packed, idx: np.ndarray, label: np.ndarray) -> DataFrame:
    """(idx, own, other, mean, mx, n): of each item the distances to the other members of each cluster.  Means are of
    exact sums, of d to 18 decimals."""
    p, ids, names, first = by_cluster(packed, idx, label)
    sizes = np.diff(np.append(first, len(ids)))

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        exact = [0 if x != x else int(Decimal(repr(x)).scaleb(18).to_integral_value(ROUND_HALF_UP)) for x in p.values.tolist()]
        upper, lower = (np.array([f(x) for x in exact], np.int64)[p.rank] for f in (lambda x: x // 10**9, lambda x: x % 10**9))
        unknown = bool(np.isnan(p.values[-1])) and np.count_nonzero(p.pop == 0) > 1
        own, same = np.searchsorted(first, np.arange(low, high), "right") - 1, 2 * p.bits + 3  # a code of distance 0
        for r in p.steps(low, high):
            code = p.codes(r, slice(0, len(p)))
            here = np.arange(r.start, r.stop)
            code[here - r.start, here] = same
            top = p.values[np.maximum.reduceat(p.rank.take(code), first, axis=1)]
            up, low_part = (np.add.reduceat(t.take(code), first, axis=1) for t in (upper, lower))
            mine = own[here - low]
            count = np.tile(sizes, (len(here), 1))
            count[here - r.start, mine] -= 1
            total = (up + low_part // 10**9).astype(np.longdouble) * 10**9 + low_part % 10**9
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (total / np.longdouble(10) ** 18).astype(float) / count
            if unknown:
                mean[np.isnan(top)] = np.nan
            keep = (count > 0).ravel()
            yield batch(idx=np.repeat(ids[here], len(names))[keep], own=np.repeat(names[mine], len(names))[keep], other=np.tile(names, len(here))[keep], mean=mean.ravel()[keep], mx=top.ravel()[keep], n=count.ravel()[keep])

    return run(spark, p, work, "idx long, own int, other int, mean double, mx double, n long")


def spread(spark: SparkSession, packed: Packed, idx: np.ndarray, label: np.ndarray) -> DataFrame:
    """(label, d, c): how many pairs inside each cluster, and with no label between two clusters, are d apart."""
    p, ids, names, first = by_cluster(packed, idx, label)
    ends = np.append(first, len(ids))[1:]

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        width = len(p.rank)
        at = int(np.searchsorted(first, low, "right")) - 1
        between = np.zeros(width, np.int64)
        while low < high:
            end = int(ends[at])
            inside = np.zeros(width, np.int64)
            for r in p.steps(low, min(high, end)):
                side = r.stop - r.start
                code = p.codes(r, slice(r.start, len(p)))
                own = code[:, : end - r.start]
                inside += np.bincount(own.ravel(), minlength=width) - np.bincount(own[:, :side][np.tri(side, dtype=bool)], minlength=width)
                between += np.bincount(code[:, end - r.start :].ravel(), minlength=width)
            yield from rows(p, inside, int(names[at]))
            low, at = min(high, end), at + 1
        yield from rows(p, between, None)

    def rows(p: Packed, counts: np.ndarray, name: int | None) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int32()), pa.array(p.values[p.rank[some]]), pa.array(counts[some])], names=["label", "d", "c"])

    found = run(spark, p, work, "label int, d double, c long", triangle=True)
    return found.groupBy("label", "d").agg(F.sum("c").alias("c"))


def to_nearest(spark: SparkSession, packed: Packed, centres: np.ndarray) -> DataFrame:
    """(i, d): distance of each item to the nearest centre other than itself; no row where there is none."""

    def work(p: Packed, low: int, high: int) -> Iterator[pa.RecordBatch]:
        place = np.full(len(p), -1)
        place[centres] = np.arange(len(centres))
        for r in p.steps(low, high, len(centres)):
            ranks = p.rank.take(p.codes(r, centres))
            mine = place[r]
            own = np.flatnonzero(mine >= 0)
            ranks[own, mine[own]] = len(p.values)
            least = ranks.min(axis=1)
            some = least < len(p.values)
            yield batch(i=np.arange(r.start, r.stop)[some], d=p.values[least[some]])

    return run(spark, packed, work, "i long, d double")
