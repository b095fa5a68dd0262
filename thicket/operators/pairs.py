"""Pair generation: all pairs, cross pairs, and joins bounded by a distance.

Fingerprints and vectors are paired in numpy, from items that every task has (`packed`, `dense`).  Pairs of any other
items, or of more than fit, are dealt out by blocks: items fall into at most MAX_BLOCKS blocks, a row is repeated once for each
block it meets, and an equi-join on the pair of blocks makes about MAX_BLOCKS^2 / 2 even tasks' worth of pairs.  No task
sees more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..model import NAN, ClusterEngineError, PairFrame
from ..sources.staging import staged
from . import dense, packed

BLOCK = 256
MAX_BLOCKS = 64
#: Cells of token hashes whose counts order the tokens in token_jaccard(), a power of 2; two bytes each go to every task.
CELLS = 1 << 22
#: Cells, the most frequent ones, that are ordered by their counts themselves; below 65,000.
HEAVY = 10_000
Kernel = Callable[[pd.DataFrame, pd.DataFrame], "object"]


def block_pairs(a: DataFrame, b: DataFrame, n_a: int, n_b: int, triangle: bool) -> DataFrame:
    """a and b (aliased) joined for all pairs; triangle: a is b and only idx_a < idx_b."""
    ka, kb = (max(1, min(MAX_BLOCKS, math.ceil(n / BLOCK))) for n in (n_a, n_b))
    own_a, own_b = F.pmod(F.col("idx"), F.lit(ka)), F.pmod(F.col("idx"), F.lit(kb))
    # with a triangle, items are dealt round-robin, so every pair of blocks holds pairs of either order
    left = a.withColumn("_ba", own_a).withColumn("_bb", F.explode(F.sequence(F.lit(0), F.lit(kb - 1))))
    right = b.withColumn("_bb", own_b).withColumn("_ba", F.explode(F.sequence(F.lit(0), F.lit(ka - 1))))
    on = (F.col("a._ba") == F.col("b._ba")) & (F.col("a._bb") == F.col("b._bb"))
    if triangle:
        on = on & (F.col("a.idx") < F.col("b.idx"))
    return left.alias("a").join(right.hint("shuffle_hash").alias("b"), on)


def pdist(items: DataFrame, metric: metrics.Metric, comparison: str, /, kind: str = "distance", cutoff: float | None = None, n: int | None = None, keep_all: bool = False, **params) -> PairFrame:
    """Distance of every pair i < j of items (idx 0..n-1, ...).  cutoff keeps d <= cutoff; keep_all (an output for all
    pairs) wins over it."""
    if cutoff is not None and kind != "distance":
        raise ValueError("a cutoff keeps small values, so it needs distances")
    if cutoff is not None and cutoff < 0:
        raise ValueError("the cutoff is negative")
    n = items.count() if n is None else n
    spark, rows = items.sparkSession, None
    source = packed.load(items, n, *metric.packed) if hasattr(metric, "packed") else None
    vectors = dense.load(items, n, *metric.dense) if hasattr(metric, "dense") else None
    if source is not None:
        df, rows = packed.pairs(spark, source), partial(packed.pairs, spark, source)
    elif vectors is not None:
        df, rows = dense.pairs(spark, vectors), partial(dense.pairs, spark, vectors)
    else:
        joined = block_pairs(items, items, n, n, True)
        df = joined.select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), metric("a", "b").alias("d"))
    whole = PairFrame(df, n, comparison, kind, params=params, source=source, rows=rows)
    return whole if cutoff is None or keep_all else whole.cut(cutoff)


def cdist(a: DataFrame, b: DataFrame, metric: metrics.Metric, cutoff: float | None = None) -> DataFrame:
    """(i, j, d) of every item of a with every item of b; a cutoff leaves pairs above it out."""
    df = block_pairs(a, b, a.count(), b.count(), False)
    out = df.select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), metric("a", "b").alias("d"))
    return out if cutoff is None else out.where(F.col("d") <= cutoff)


def cdist_zeroed(a: DataFrame, b: DataFrame, metric: metrics.Metric, cutoff: float) -> DataFrame:
    """Every cross pair, with 0.0 in place of distances above the cutoff (the dense form of a cut-off matrix)."""
    return cdist(a, b, metric).withColumn("d", F.when(F.col("d") <= cutoff, F.col("d")).otherwise(0.0))


def pdist_kernel(items: DataFrame, kernel: Kernel, comparison: str, columns: list[str], kind: str = "distance", n: int | None = None) -> PairFrame:
    """pdist with a user's bulk kernel: kernel(left, right) gives the matrix of two blocks of items (pandas frames)."""
    n = items.count() if n is None else n
    k = max(1, min(MAX_BLOCKS, math.ceil(n / BLOCK)))
    packed = items.select("idx", *columns).groupBy(F.pmod("idx", F.lit(k)).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("rows"))
    x, y = packed.alias("x"), packed.alias("y")
    grid = items.sparkSession.range(k).select(F.col("id").cast("int").alias("p"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(k - 1))).alias("q"))
    both = grid.join(x, F.col("p") == F.col("x.blk")).join(y, F.col("q") == F.col("y.blk")).select("p", "q", F.col("x.rows").alias("l"), F.col("y.rows").alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right, same in zip(batch["l"], batch["r"], batch["p"] == batch["q"], strict=True):
                a, b = (pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in rows]) for rows in (left, right))
                d = np.asarray(kernel(a, b), dtype=float)
                i, j = np.meshgrid(a["idx"].to_numpy(), b["idx"].to_numpy(), indexing="ij")
                keep = i < j if same else np.ones_like(d, dtype=bool)
                yield pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "d": d[keep]})

    return PairFrame(both.mapInPandas(run, "i long, j long, d double"), n, comparison, kind)


def cdist_kernel(a: DataFrame, b: DataFrame, kernel: Kernel, columns: list[str]) -> DataFrame:
    """(i, j, d) of every item of a with every item of b, by a user's bulk kernel over two blocks of items."""
    sizes = [max(1, min(MAX_BLOCKS, math.ceil(x.count() / BLOCK))) for x in (a, b)]
    packed = [x.select("idx", *columns).groupBy(F.pmod("idx", F.lit(k)).cast("int").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("rows")) for x, k in zip((a, b), sizes, strict=True)]
    x, y = packed[0].toDF("p", "l"), packed[1].toDF("q", "r")
    grid = a.sparkSession.range(sizes[0]).select(F.col("id").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(sizes[1] - 1))).alias("q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["l"], batch["r"], strict=True):
                one, two = (pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in rows]) for rows in (left, right))
                d = np.asarray(kernel(one, two), dtype=float)
                i, j = np.meshgrid(one["idx"].to_numpy(), two["idx"].to_numpy(), indexing="ij")
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "d": d.ravel()})

    return grid.join(x, "p").join(y, "q").select("l", "r").mapInPandas(run, "i long, j long, d double")


def similarity_join(items: DataFrame, cutoff: float, size: int, n_words: int = 1, n: int | None = None) -> PairFrame:
    """Exact pairs with Tanimoto distance <= cutoff (below 1), without looking at all pairs.

    Prefix filter (Bayardo et al., 2007): with the bits ordered from rare to frequent, two fingerprints of similarity t
    or more share a bit among the first p - ceil(t * p) + 1 of each.  Candidates come from an equi-join on those bits
    with the size bound t * p <= q <= p / t, each pair once (at its first common prefix bit).  Where bits are so common
    that the prefixes' buckets hold more pairs than there are, the blocks of pdist() are used instead.
    """
    from ..functions.fingerprints import bits_of

    if not 0 <= cutoff < 1:
        raise ValueError("the cutoff must be in [0, 1)")
    t = 1.0 - cutoff
    n = items.count() if n is None else n
    bits = items.select("idx", "popcount", F.explode(bits_of(F.col("words"), size)).alias("bit"))
    rank = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("f"))
    length = F.col("popcount") - F.ceil(F.lit(t - 1e-12) * F.col("popcount")) + 1
    ranked = bits.join(F.broadcast(rank), "bit").groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("f", "bit"))).alias("all"))  # rank: one row per bit of the width
    prefixed = items.join(ranked, "idx").withColumn("prefix", F.slice(F.transform("all", lambda x: x["bit"]), F.lit(1), length.cast("int"))).drop("all")
    prefixed = staged(prefixed.select("idx", "words", "popcount", "prefix"), "prefixes")
    spread = prefixed.withColumn("bit", F.explode("prefix"))
    held = spread.groupBy("bit").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0))).first()[0]
    if held > n * (n - 1) / 2:
        return pdist(items, metrics.fingerprint("tanimoto", n_words=n_words), "tanimoto", cutoff=cutoff, n=n)
    on = (F.col("a.bit") == F.col("b.bit")) & (F.col("a.idx") < F.col("b.idx"))
    on = on & (F.col("b.popcount") >= F.lit(t - 1e-12) * F.col("a.popcount")) & (F.col("a.popcount") >= F.lit(t - 1e-12) * F.col("b.popcount"))
    first = F.filter(F.col("a.prefix"), lambda x: F.array_contains(F.col("b.prefix"), x))[0] == F.col("a.bit")
    joined = spread.alias("a").join(spread.alias("b"), on).where(first)
    df = joined.select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), metrics.fingerprint("tanimoto", n_words=n_words)("a", "b").alias("d"))
    return PairFrame(df.where(F.col("d") <= cutoff), n, "tanimoto", "distance", False, cutoff)


def token_jaccard(docs: DataFrame, id_col: str, tokens: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact similarity join of token sets (Jaccard >= threshold, above 0), as links (i, j, jaccard) with i < j between
    classes of equal sets, each named by its smallest id, and members (idx, class_id, class_size) of every row; so copies
    never meet in pairs.  An empty set is alone in its class.

    Prefix filter: with tokens in one order for all, from rare to frequent, two similar sets share one among the first
    n - ceil(threshold * n) + 1 of each.  The order is that of the logarithm, in fourths, of how often the tokens of a
    hash's cell occur (of the HEAVY most frequent cells: the count itself), then of the hash; any order is exact, and
    this one tells tokens apart at every frequency.  Tokens are 64 bits of hash, a set is its tokens' 128.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    least = threshold - 1e-12
    hashes = F.array_sort(F.array_distinct(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.xxhash64(w))))
    rows = docs.select(F.col(id_col).alias("idx"), hashes.alias("tok"))
    alone = F.when(F.size("tok") == 0, F.col("idx"))
    rows = rows.withColumns({"k1": F.xxhash64("tok", alone), "k2": F.xxhash64(F.lit(1), "tok", alone)})
    sets = staged(rows.groupBy("k1", "k2").agg(F.min("idx").alias("node"), F.count(F.lit(1)).alias("class_size"), F.first("tok").alias("tok")), "token-sets", release=True)
    members = rows.select("idx", "k1", "k2").join(sets.select("k1", "k2", "node", "class_size"), ["k1", "k2"]).select("idx", F.col("node").alias("class_id"), "class_size")

    cells = sets.select(F.explode("tok").alias("t")).groupBy(F.col("t").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("f"))
    counted = cells.where("f > 1").toArrow()
    cell, f = (counted.column(c).to_numpy() for c in ("cell", "f"))
    levels = np.zeros(CELLS, np.uint16)
    levels[cell] = 4 * np.log2(f)  # 255 at most
    top = np.lexsort((cell, f))[max(0, len(f) - HEAVY) :]
    levels[cell[top]] = 256 + np.arange(len(top))
    place = docs.sparkSession.sparkContext.broadcast(levels)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, n, prefix) of every set."""
        level = place.value
        for batch in batches:
            tok = batch.column(1)
            flat, sizes = tok.flatten().to_numpy(), tok.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, level[flat & (len(level) - 1)], row))
            first = np.cumsum(sizes) - sizes
            lengths = sizes - np.ceil(least * sizes).astype(sizes.dtype) + 1
            kept = flat[order][np.arange(len(flat)) - first[row] < lengths[row]]
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), prefix], names=["node", "n", "prefix"])

    kind = sets.schema["node"].dataType.simpleString()
    prefixes = sets.where(F.size("tok") > 0).select("node", "tok").mapInArrow(ordered, f"node {kind}, n int, prefix array<long>")
    spread = staged(prefixes.select("node", "n", F.posexplode("prefix").alias("at", "t")), "prefixes", release=True)
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.node") < F.col("b.node")) & (F.col("b.n") >= least * F.col("a.n")) & (F.col("a.n") >= least * F.col("b.n"))
    # from their first common token on, two sets must have enough left to share
    on = on & (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    pairs = spread.alias("a").join(spread.alias("b"), on).select(F.col("a.node").alias("i"), F.col("b.node").alias("j")).distinct()
    pairs = staged(pairs, "candidates", release=True)
    # a pair takes its first set along, so pairs go in turns that carry about half of all sets' tokens each
    turns = max(1, math.ceil(2 * pairs.count() / max(1, sets.count())))
    found = [_checked(pairs.where(F.pmod(F.xxhash64("i"), F.lit(turns)) == k), sets, threshold) for k in range(turns)]
    return reduce(DataFrame.union, found), members


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j, jaccard) of the pairs that reach the threshold.  Only sets that a pair asks for are shuffled, by cells of
    their names' hashes."""
    cell = lambda c: F.xxhash64(c).bitwiseAND(CELLS - 1).cast("int").alias("cell")
    asked = np.zeros(CELLS, bool)
    asked[pairs.select(F.explode(F.array("i", "j")).alias("node")).select(cell("node")).distinct().toArrow().column(0).to_numpy()] = True
    wanted = sets.sparkSession.sparkContext.broadcast(asked)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value[batch.column(2).to_numpy()])).select([0, 1])

    kind = sets.schema["node"].dataType.simpleString()
    some = sets.select("node", "tok", cell("node")).mapInArrow(named, f"node {kind}, tok array<long>")
    x, y = (some.select(F.col("node").alias(c), F.col("tok").alias(f"t{c}")) for c in "ij")
    both = F.size(F.array_intersect("ti", "tj"))
    found = pairs.join(x, "i").join(y, "j").select("i", "j", (both / (F.size("ti") + F.size("tj") - both)).alias("jaccard"))
    return staged(found.where(F.col("jaccard") >= threshold), "token-links", release=True)


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(idx, class_id, n_links): with how many other rows each row is linked, from classes and the links between them."""
    size = members.select("class_id", "class_size").distinct()
    ends = links.select("i", "j").union(links.select("j", "i")).toDF("class_id", "other")
    near = ends.join(size.toDF("other", "others"), "other").groupBy("class_id").agg(F.sum("others").alias("more"))
    known = members.join(near, "class_id", "left")
    return known.select("idx", "class_id", (F.col("class_size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))


def core_distances(pairs: PairFrame, k: int) -> DataFrame:
    """(idx, core): distance to the k-th nearest item, an item being its own nearest."""
    from pyspark.sql import Window

    pairs.require(complete=True)
    if k < 1 or k > pairs.n:
        raise ValueError("k must be between 1 and the number of items")
    if k == 1:
        return pairs.items().select("idx", F.lit(0.0).alias("core"))
    if pairs.source is not None:
        return nearest(pairs, k - 1).where(F.col("rank") == k - 1).select("idx", F.col("d").alias("core"))
    w = Window.partitionBy("i").orderBy("d", "j")
    return pairs.symmetric().withColumn("r", F.row_number().over(w)).where(F.col("r") == k - 1).select(F.col("i").alias("idx"), F.col("d").alias("core"))


def mutual_reachability(pairs: PairFrame, k: int, digits: int) -> DataFrame:
    """(i, j, d) of all pairs: the largest of their distance and both core distances, rounded."""
    core = staged(core_distances(pairs, k), "core")
    if pairs.source is not None:
        found = core.toArrow()
        own = found.column("core").to_numpy()[found.column("idx").to_numpy().argsort()]
        return packed.pairs(pairs.df.sparkSession, pairs.source, digits, core=own)
    both = pairs.df.join(core.toDF("i", "ci"), "i").join(core.toDF("j", "cj"), "j")
    return both.select("i", "j", F.round(metrics.mutual_reachability(F.col("ci"), F.col("cj"), F.col("d")), digits).alias("d"))


def nearest(pairs: PairFrame, k: int) -> DataFrame:
    """(idx, rank, neighbour, d): the k nearest other items, ties by index."""
    if pairs.source is not None and pairs.cutoff is None and pairs.kind == "distance":
        return packed.nearest(pairs.df.sparkSession, pairs.source, k)
    from pyspark.sql import Window

    w = Window.partitionBy("i").orderBy("d", "j")
    found = pairs.symmetric().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(F.col("i").alias("idx"), "rank", F.col("j").alias("neighbour"), "d")


def degree(pairs: PairFrame, threshold: float) -> DataFrame:
    """(idx, count): items at most `threshold` away, the item itself included."""
    if threshold < 0:
        raise ValueError("the threshold is negative")
    pairs.require(threshold=threshold)
    if pairs.source is not None:
        return packed.degrees(pairs.df.sparkSession, pairs.source, threshold).select("idx", (F.col("count") + 1).alias("count"))
    found = pairs.within(threshold).groupBy("src").agg(F.count(F.lit(1)).alias("c"))
    items = pairs.items()
    return items.join(found, items.idx == found.src, "left").select("idx", (F.coalesce("c", F.lit(0)) + 1).alias("count"))


def no_nan(d: Column) -> Column:
    """A distance, or an error where it isn't a number: no clustering is defined for those."""
    return F.when(F.isnan(d), F.raise_error(F.lit("NaN distance"))).otherwise(d)


__all__ = ["NAN", "ClusterEngineError", "block_pairs", "cdist", "cdist_zeroed", "core_distances", "cdist_kernel", "degree", "link_counts", "mutual_reachability", "nearest", "no_nan", "pdist", "pdist_kernel", "similarity_join", "token_jaccard"]
