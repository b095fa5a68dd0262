"""Near duplicates by ProbMinHash (Ertl, 2020) over weighted five-word shingles.

A shingle's weight is its count in the text, and two texts are as similar as the probability Jaccard of their weighted
shingles: J_P = sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i); for shingles that occur once each this is
|A n B| / |A u B|.  Every shingle is the source of a Poisson process with its weight as rate, whose arrivals fall on
random components of the sketch; a component keeps its first arrival, and a process ends as soon as its next arrival is
later than everything kept.  Two sketches agree in a component with probability J_P.

The sketch is cut into BANDS bands; texts that agree in a band are candidates; a candidate pair is verified on the texts
themselves unless bitmaps of their shingles show that it can't be similar, which is exact: in how many components sketches
agree drops no pair.  Components of verified links are the classes.  Pairs within a bucket are never all written out.
Buckets are settled in rounds: each round, one member of every bucket that still holds several components, the pivot,
meets the members of other components, and leaves; so a round makes at most one pair for each member, and members that
are linked to each other need no pair.  When rounds no longer shrink what is apart, or it is little (FEW), the members
outside the bucket's largest component meet all others in blocks inside tasks.
Buckets with more than SPLIT such members are first cut by rare shingles, one of which any two similar texts share, so
that no link is lost: J_P is at most 1 / (1/a + 1/b - 1) where shared shingles have the shares a and b of the weights of
the two texts.  What is still large after that meets in blocks as well, whole.

Words are runs of non-space, compared after str.lower().  A text of one to four words has one shingle, of all its
words; a text without words, empty or null, is alone in its class unless its very text is repeated.  Equal texts are one
node throughout.  Rows that repeat are members of one class, of which one row stays; ties between equal ids are settled
by the row's place in the input.  Empty tables give empty results, long texts are read whole, and columns of other names
than the text's and the id's are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import BROADCAST_ROWS, byte_chunks, checked_join, few_rows, staged, texts_of, tidy
from .wordhash import Batch, mix, uniform

SHINGLE = 5
THRESHOLD = 0.8
COMPONENTS = 64
BANDS = 16
LANES = COMPONENTS // BANDS
#: Members outside the largest component, and members of any, that are held against each other in one task.
BLOCK, OTHERS = 256, 1024
#: Members outside the largest component from which a bucket is cut by rare shingles.
SPLIT = 2_048
#: Rounds of pivots go on while a round leaves at most this share of the members that were apart.
SHRINK = 0.7
#: Members apart in all buckets that need no more rounds: they meet in blocks at once.
FEW = 20_000
#: Bits of the map of a text's shingles, by which pairs that can't be similar are passed over.
BITS = 1024
#: What is kept of each text: packed sketch, bitmap and weight of all shingles.
SKETCHED = ("_sketch", "_bits", "_size")
_SKETCHED = "_sketch array<long>, _bits array<long>, _size double"
_GOLDEN = 0x9E3779B97F4A7C15


def _step(k: int) -> np.uint64:
    return np.uint64(k * _GOLDEN & 0xFFFFFFFFFFFFFFFF)



def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles of each text, ordered by text and shingle."""
    h, who, _ = Batch([t.lower().encode("utf-8", "surrogatepass") for t in texts]).ngrams(SHINGLE, whole_if_short=True)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(first)
    return who[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def sketches(n: int, who: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """n x m array: the shingle whose arrival is first in each component (0 for texts without shingles)."""
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)

    def arrive(time: np.ndarray, element: np.ndarray, turn: int) -> None:
        where = mix(shingle[element] + _step(2 * turn + 1)) % np.uint64(m)
        slot = who[element] * m + where.astype(np.int64)
        better = time < first[slot]
        slot, time, element = slot[better], time[better], element[better]
        order = np.argsort(-time, kind="stable")
        first[slot[order]], kept[slot[order]] = time[order], shingle[element[order]]

    def gap(element: np.ndarray, turn: int) -> np.ndarray:
        return -np.log(uniform(mix(shingle[element] ^ _step(2 * turn + 2)))) / weight[element]

    def last() -> np.ndarray:
        return first.reshape(n, m).max(axis=1)

    active = np.arange(len(shingle))
    time = gap(active, 0)
    # early arrivals first: once they fill the sketch, most later ones need no look at all
    early = time <= (m * (math.log(m) + 2.0) / np.bincount(who, weights=weight, minlength=n).clip(1e-300))[who]
    arrive(time[early], active[early], 0)
    late = np.flatnonzero(~early & (time < last()[who]))
    arrive(time[late], active[late], 0)
    turn = 0
    while len(active):
        going = time < last()[who[active]]
        active, time, turn = active[going], time[going], turn + 1
        time = time + gap(active, turn)
        going = time < last()[who[active]]
        active, time = active[going], time[going]
        arrive(time, active, turn)
    return kept.reshape(n, m)


def packed(sketch: np.ndarray) -> np.ndarray:
    """Sixteen bits of each component, four to a 64-bit value: n x BANDS."""
    low = (mix(sketch) & np.uint64(0xFFFF)).reshape(len(sketch), BANDS, LANES)
    out = np.zeros(low.shape[:2], dtype=np.uint64)
    for k in range(LANES):
        out |= low[:, :, k] << np.uint64(16 * k)
    return out


def bitmaps(n: int, who: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """n x BITS / 64: each shingle sets one bit of its text's map."""
    out = np.zeros((n, BITS), dtype=bool)
    out[who, (mix(shingle ^ np.uint64(_GOLDEN)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def may_be_alike(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts with the bitmaps a, b and the weights x, y may be similar.  A bit of one text only is a shingle of
    that text only, of weight 1 at least, which bounds the shares of what is shared, and these bound J_P."""
    alone = (np.bitwise_count(p & ~q).sum(axis=-1, dtype=np.int64) for p, q in ((a, b), (b, a)))
    inverse = sum(w / np.maximum(w - n, 1e-9) for w, n in zip((x, y), alone, strict=True))
    return inverse <= 1 + 1 / threshold + 1e-9


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, out, maps, weights = batch.column(2), [], [], []
        for start, stop in byte_chunks(text):
            who, shingle, weight = weighted_shingles(texts_of(text, start, stop))
            out.append(packed(sketches(stop - start, who, shingle, weight)))
            maps.append(bitmaps(stop - start, who, shingle))
            weights.append(np.bincount(who, weights=weight, minlength=stop - start))
        size = np.concatenate(weights) if out else np.zeros(0)
        sketch, bits = (_lists(np.concatenate(x) if x else np.zeros((0, 1), np.uint64)) for x in (out, maps))
        sketch = pa.compute.if_else(pa.array(size > 0), sketch, pa.scalar(None, sketch.type))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sketch, bits, pa.array(size)], names=["_id", "_text_key", *SKETCHED])


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.astype(np.uint64).view(np.int64).ravel()))


def similarity(a: str, b: str) -> float:
    """Probability Jaccard of two texts; 0 if either has no words."""
    who, shingle, weight = weighted_shingles([a, b])
    cut = int(np.searchsorted(who, 1))
    return probability_jaccard(shingle[:cut], weight[:cut], shingle[cut:], weight[cut:])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact J_P of two weighted sets, each sorted by element: elements with equal weight pairs are handled together."""
    if not len(a) or not len(b):
        return 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_a, only_b = np.delete(x, ia), np.delete(y, ib)
    pairs, n = np.unique(np.stack([x[ia], y[ib]]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), k in zip(pairs.T, n, strict=True):
        total += k / (np.sum(n * np.maximum(pairs[0] / p, pairs[1] / q)) + only_a.sum() / p + only_b.sum() / q)
    return float(total)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        good = [similarity(a, b) >= threshold - 1e-12 for a, b in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["src", "dst"])


def _keyed(df: DataFrame, text: str, id_col: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), F.unhex(F.md5(body)).alias("_text_key"), body.alias("_text"))


def _may_be_alike(a: str, b: str, threshold: float) -> Column:
    """may_be_alike() of the columns _bits and _size with the suffixes a and b."""

    def inverse(p: str, q: str) -> Column:
        alone = F.zip_with(f"_bits{p}", f"_bits{q}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(f"_size{p}") / F.greatest(F.col(f"_size{p}") - F.aggregate(alone, F.lit(0), lambda n, x: n + x), F.lit(1e-9))

    return inverse(a, b) + inverse(b, a) <= 1 + 1 / threshold + 1e-9


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar, as edges.  Texts are fetched for pairs whose bitmaps allow it."""
    a, b = (nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("_bits", "_size"))) for c in "ab")
    near = pairs.distinct().join(a, "a").join(b, "b").where(_may_be_alike("a", "b", threshold)).select("a", "b")
    a, b = (texts.select(F.col("node").alias(c), F.col("_text").alias(f"_t{c}")) for c in "ab")
    with few_rows(pairs.sparkSession, 128):
        return staged(near.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb").mapInArrow(tidy(lambda x: _verify(x, threshold)), "src long, dst long"), "links")


def _candidates(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i outside the largest component, j) of one block pair that are worth a look at their texts, the most alike
    first, and in how many components each agrees.  A pair is looked at in the first band that it shares."""
    band = group.column("band")[0].as_py()
    node, comp, side, out, size = (group.column(c).to_numpy() for c in ("node", "c", "side", "out", "_size"))
    sketch, bits = (group.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1) for c in ("_sketch", "_bits"))
    lanes = sketch.view(np.uint16)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = []
    for i in left.tolist():
        j = right[(comp[right] != comp[i]) & (~out[right] | (node[right] > node[i]))]
        j = j[may_be_alike(bits[i], size[i], bits[j], size[j], threshold)]
        j = j[(sketch[j, :band] != sketch[i, :band]).all(axis=1)]
        found.append(np.stack([np.full(len(j), i), j, (lanes[j] == lanes[i]).sum(axis=1)]))
    i, j, agree = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.argsort(-agree, kind="stable")
    return i[order], j[order], agree[order]


def _wanted(group: pa.Table, threshold: float) -> pa.Table:
    """The rows of one block pair that have a candidate."""
    i, j, _ = _candidates(group, threshold)
    return group.take(pa.array(np.unique(np.concatenate((i, j)))))


class Shingled:
    """The weighted shingles of several texts, for comparing one with many."""

    def __init__(self, texts: list[str]):
        who, self.shingle, self.weight = weighted_shingles(texts)
        self.bounds = np.searchsorted(who, np.arange(len(texts) + 1))
        self.single = np.bincount(who, weights=self.weight != 1.0, minlength=len(texts)) == 0

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[k], self.bounds[k + 1])
        return self.shingle[part], self.weight[part]

    def similarities(self, i: int, many: np.ndarray) -> np.ndarray:
        """Probability Jaccard of text i and each of many; where no shingle repeats, this is a ratio of counts."""
        a, x = self.of(i)
        sizes = self.bounds[many + 1] - self.bounds[many]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[many] - (ends - sizes), sizes)
        s = self.shingle[at]
        shared = a[np.minimum(np.searchsorted(a, s), len(a) - 1)] == s if len(a) else np.zeros(len(s), bool)
        both = np.bincount(np.repeat(np.arange(len(many)), sizes), weights=shared, minlength=len(many))
        out = both / np.maximum(len(a) + sizes - both, 1)
        for k in np.flatnonzero(~(self.single[many] & self.single[i]) & (both > 0)).tolist():
            out[k] = probability_jaccard(a, x, *self.of(int(many[k])))
        return out


def _meet(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the members of one block pair that are in different components.  Pairs that the links found here
    already connect are passed over."""
    node, comp = (group.column(c).to_numpy() for c in ("node", "c"))
    _, root = np.unique(comp, return_inverse=True)
    known = Shingled(texts_of(group.column("_text")))
    i, j, _ = _candidates(group, threshold)
    src, dst = [], []
    for a in np.unique(i).tolist():
        others = j[i == a]
        others = others[root[others] != root[a]]
        for b in others[known.similarities(a, others) >= threshold - 1e-12].tolist():
            if root[a] != root[b]:
                root[root == root[b]] = root[a]
                src.append(int(node[a]))
                dst.append(int(node[b]))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, and what share of the text's weight each has."""
    for batch in batches:
        node, text = batch.column(0).to_numpy(), batch.column(1)
        for start, stop in byte_chunks(text):
            who, shingle, weight = weighted_shingles(texts_of(text, start, stop))
            share = weight / np.bincount(who, weights=weight, minlength=stop - start)[who]
            yield pa.RecordBatch.from_arrays([pa.array(node[start:stop][who]), pa.array(shingle.view(np.int64)), pa.array(share)], names=["node", "shingle", "share"])


def _rare_shingles(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, shingle, n, rest): shingles in order of the number n of texts that have them, up to the last one from
    which the rest of the text's weight, itself included, is `threshold`.  All that two texts share lies in the rests
    of the first shingle they share, and J_P is at most either rest, so similar texts have that shingle here."""
    shares = staged(texts.select("node", "_text").mapInArrow(tidy(_shares), "node long, shingle long, share double"), "shares")
    common = staged(shares.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    before = Window.partitionBy("node").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    ranked = checked_join(shares, common, "shingle").withColumn("n", F.coalesce("n", F.lit(1)))
    ranked = ranked.withColumn("rest", 1 - F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    return ranked.where((F.col("n") > 1) & (F.col("rest") >= threshold - 1e-9)).select("node", "shingle", "n", "rest")


def _cut(large: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Members (bucket, band, node, c) dealt to smaller buckets, one for each rare shingle, without losing a link.  Of
    two similar texts one at least has the flag `lead`: 1 / J_P >= 1/a + 1/b - 1 asks for a or b of 2 t / (1 + t)."""
    rare = _rare_shingles(texts.join(large.select("node").distinct(), "node"), threshold)
    met = staged(large.select("bucket", "band", "node", "c").join(rare, "node"), "rare")
    alike = (F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2))
    groups = met.groupBy("bucket", "n", "shingle").agg(F.max("rest").alias("most"), F.count(F.lit(1)).alias("many"), *alike, F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    # of shingles with the same members, the first
    order = F.struct("n", "shingle")
    groups = groups.groupBy("bucket", "many", "x0", "x1").agg(F.min_by("shingle", order).alias("shingle"), F.min_by("most", order).alias("most"))
    near = met.join(groups.select("bucket", "shingle", "most"), ["bucket", "shingle"]).where(1 / F.col("rest") + 1 / F.col("most") <= 1 + 1 / threshold + 1e-9)
    return near.select(F.xxhash64("bucket", "shingle").alias("bucket"), "band", "node", "c", (F.col("rest") >= 2 * threshold / (1 + threshold) - 1e-9).alias("lead"))


def _mixed(members: DataFrame, sketch: DataFrame) -> DataFrame:
    """The members (bucket, band, node, c, lead) of buckets that hold several components.  `out` marks those that meet
    all: the ones outside the largest component, or the leads if they are fewer."""
    sizes = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"), F.count_if("lead").alias("leads"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("leads").alias("leads"))
    mixed = mixed.where("most < n and leads > 0").withColumn("by_lead", F.col("leads") < F.col("n") - F.col("most"))
    inner = members.join(mixed, "bucket").withColumn("outside", F.least("leads", F.col("n") - F.col("most")))
    inner = inner.withColumn("out", F.when(F.col("by_lead"), F.col("lead")).otherwise(F.col("c") != F.col("main")))
    return staged(inner.select("bucket", "band", "node", "c", "n", "outside", "out").join(sketch, "node"), "mixed")


def _cross_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links among the members (bucket, band, node, c) of buckets that hold several components: all that are outside the
    bucket's largest component against all, in buckets that have more than SPLIT of them by rare shingles.  A member
    stands in as many rows as the others fill blocks; texts are fetched only for members that have a candidate by their
    bitmaps."""
    spark, sketch = members.sparkSession, nodes.select("node", *SKETCHED)
    done = _mixed(members.withColumn("lead", F.lit(True)), sketch)
    large = done.where(F.col("outside") > SPLIT)
    if not large.isEmpty():
        done = done.where(F.col("outside") <= SPLIT).unionByName(_mixed(staged(_cut(large, texts, threshold), "cut"), sketch))
    blocks, others = (F.ceil(F.col(c) / k).cast("int") for c, k in (("outside", BLOCK), ("n", OTHERS)))
    fields = ["bucket", "band", "node", "c", "out", *SKETCHED]
    first = done.where("out").withColumn("p", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), others - 1))).withColumn("side", F.lit(0))
    second = done.withColumn("p", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("q", F.pmod(F.xxhash64("node", F.lit(1)), others).cast("int")).withColumn("side", F.lit(1))
    dealt = first.select(*fields, "p", "q", "side").union(second.select(*fields, "p", "q", "side"))
    schema = f"bucket long, band int, node long, c long, out boolean, {_SKETCHED}, p int, q int, side int"
    wanted = staged(dealt.groupBy("bucket", "p", "q").applyInArrow(lambda t: _wanted(t, threshold), schema), "wanted")
    with few_rows(spark, 512):
        return staged(wanted.join(texts, "node").groupBy("bucket", "p", "q").applyInArrow(lambda t: _meet(t, threshold), "src long, dst long"), "links")


def classes(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(_id, _text_key, node, component) of every row: rows of one component are near duplicates of each other.  The
    bands are made for thresholds of THRESHOLD and more."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands would lose links below {THRESHOLD}")
    kind = df.schema[id_col].dataType.simpleString()
    rows = _keyed(df, text, id_col).mapInArrow(tidy(_sketch_batches), f"_id {kind}, _text_key binary, {_SKETCHED}")
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "sketches")
    nodes = staged(rows.groupBy("_text_key").agg(F.min("_row").alias("node"), *(F.first(c).alias(c) for c in SKETCHED)), "nodes")

    banded = nodes.where("_sketch is not null").select("node", F.posexplode("_sketch").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(banded.join(shared, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "band", "node"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "_text_key"), "node").select("node", "_text_key")
    # each task keeps one copy of a text before the shuffle, so a text that many rows share stays small
    once = _keyed(df, text, id_col).select("_text_key", "_text").dropDuplicates(["_text_key"])
    texts = staged(once.join(wanted, "_text_key").select("node", "_text"), "texts")

    label = staged(nodes.select("node", F.col("node").alias("component")).limit(0), "components")

    def with_label(x: DataFrame, node: str, name: str) -> DataFrame:
        known = label.select(F.col("node").alias(node), F.col("component").alias(name))
        return x.join(known, node, "left").withColumn(name, F.coalesce(name, node))

    def joined(label: DataFrame, more: DataFrame) -> DataFrame:
        """Labels after new links: only the components that the links touch are connected anew."""
        between = with_label(with_label(more, "src", "a"), "dst", "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        merged = components(between).toDF("component", "into")
        ends = more.select(F.col("src").alias("node")).union(more.select("dst")).distinct()
        known = label.union(ends.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))
        return staged(known.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "components")

    before, turn = None, 0
    while True:
        now = with_label(members, "node", "c")
        pivots = now.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max_by(F.struct("node", "c"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("pivot")).where("c0 < c1")
        met = now.join(pivots.select("bucket", F.col("pivot.node").alias("pivot"), F.col("pivot.c").alias("d")), "bucket").where("node <> pivot")
        met = staged(met.select("bucket", "band", "node", "pivot", (F.col("c") != F.col("d")).alias("apart")), "met")
        members = met.select("bucket", "band", "node")
        n = met.where("apart").count()
        if n:
            more = _links(met.where("apart").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), nodes, texts, threshold)
            if not more.isEmpty():
                label = joined(label, more)
        elif met.isEmpty():
            break
        if n <= FEW or before is not None and n > SHRINK * before:
            more = _cross_links(with_label(members, "node", "c"), nodes, texts, threshold)
            if not more.isEmpty():
                label = joined(label, more)
            break
        before, turn = n, turn + 1

    out = rows.select("_id", "_text_key", "_row").join(nodes.select("_text_key", "node"), "_text_key")
    return staged(with_label(out, "node", "component"), "classes")


def decide(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: doc_id, class_id (smallest doc_id of the class), class_size, kept (the row with the
    smallest doc_id stays; of rows that tie in doc_id exactly one)."""
    rows = classes(df, text, id_col, threshold)
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    # written first: a join of two scans can be split where one class is large
    joined = rows.join(staged(least.where("class_size > 1"), "least"), "component", "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("class_size").isNull(), F.col("_id")).otherwise(F.col("least._id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("_row") == F.col("least._row"), F.lit(True)).alias("kept"),
    )


def keep(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that stay, with df's columns: of each class the text of the row with the smallest doc_id, once."""
    rows = classes(df, text, id_col, threshold)
    order = F.struct(F.col("_id").isNull(), "_id", "_row")
    least = rows.groupBy("component").agg(F.min(F.struct(order.alias("o"), "_text_key", "_id")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = staged(least, "least")
    grouped = rows.join(least, "component")
    out = grouped.select("_text_key").distinct()
    stay = least.select(F.col("least._text_key").alias("_text_key"), F.col("least._id").alias("_id"))
    out, stay = staged(out, "grouped"), staged(stay, "stay")
    if out.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out, stay = F.broadcast(out), F.broadcast(stay)
    fields = df.columns
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("_all"), F.col(id_col).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_text_key"))
    chosen = keyed.join(stay.withColumnRenamed("_id", "_keep"), "_text_key").where(F.col("_id").eqNullSafe(F.col("_keep"))).drop("_keep").dropDuplicates(["_text_key"])
    alone = keyed.join(out, "_text_key", "left_anti")
    return alone.select("_all").union(chosen.select("_all")).select(*[F.col("_all").getField(c).alias(c) for c in fields])
