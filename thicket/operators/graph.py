"""Graph operators on edge tables: neighbourhoods, connected components, independent sets.

Edges are rows (src, dst).  Loops run on the driver, one small aggregate per round decides when to stop, and every round
is written to the shared folder so that lineage stays short and lost executors cost one round only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


#: Edges (16 bytes each) that one task may hold.
LOCAL_EDGES = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and repeats."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select(F.col("dst"), F.col("src"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them (edges point from larger to smaller)."""
    low = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(low, "src").select(F.col("dst").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(low.select("src", "m")).distinct().toDF("src", "dst")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars: every node linked to the smallest node it is connected to here."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    src, dst = flat.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[src], root[dst])
        before = root.copy()
        np.minimum.at(root, root[src], low)
        np.minimum.at(root, root[dst], low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        if np.array_equal(root, before):
            break
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["src", "dst"])


def components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node (bigint) that has an edge; component is the smallest node of it.

    Each partition first shrinks its own edges to stars.  A graph of at most `local_edges` edges, which is counted, is
    one partition and done by that.  Larger graphs alternate large-star and small-star steps (Kiveris et al., 2014),
    which end in O(log^2 n) rounds: no vertex ever gathers more than its own edges, and the joins can be split by
    adaptive execution where a vertex is hot.
    """
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    if e.limit(local_edges + 1).count() <= local_edges:
        e = staged(e.coalesce(1).mapInArrow(_forest, "src bigint, dst bigint"), "stars")
    else:
        e = staged(e.distinct(), "edges")
        e = staged(e.mapInArrow(_forest, "src bigint, dst bigint").distinct(), "stars")
        seen = None
        for _ in range(max_rounds):
            e = staged(_small_star(_large_star(e)), "stars")
            now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.union(e.select(F.col("dst"), F.col("dst")).distinct())


def _first_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(idx, centre) of a whole graph given as (src, dst, pri of src), node by node from the highest priority down."""
    parts = [np.stack([b.column(k).to_numpy() for k in range(3)]) for b in batches if b.num_rows]
    if not parts:
        return
    src, dst, pri = np.concatenate(parts, axis=1)
    nodes, first, flat = np.unique(src, return_index=True, return_inverse=True)
    order = np.argsort(flat, kind="stable")
    neighbour = np.searchsorted(nodes, dst[order])
    bounds = np.searchsorted(flat[order], np.arange(len(nodes) + 1))
    state = np.zeros(len(nodes), np.int8)
    for k in np.argsort(-pri[first], kind="stable").tolist():
        if state[k] == 0:
            state[neighbour[bounds[k] : bounds[k + 1]]] = 2
            state[k] = 1
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(state == 1)], names=["idx", "centre"])


def independent_set(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The lexicographically first maximal independent set.

    nodes: (idx, pri) with distinct priorities; edges: both directions of (src, dst).  Returns (idx, pri, centre).
    A graph of at most `local_edges` edges, which are counted, is gone through in one task.  Beyond that, each round
    admits every undecided node whose priority beats those of its undecided neighbours, then rules out their
    neighbours; this equals going through the nodes one by one from the highest priority down.
    """
    if edges.limit(local_edges + 1).count() <= local_edges:
        whole = edges.join(nodes.select(F.col("idx").alias("src"), "pri"), "src").select("src", "dst", "pri")
        found = whole.coalesce(1).mapInArrow(_first_set, "idx bigint, centre boolean")
        return staged(nodes.join(found, "idx", "left").select("idx", "pri", F.coalesce("centre", F.lit(True)).alias("centre")), "mis")
    state = staged(nodes.select("idx", "pri", F.lit(None).cast("boolean").alias("centre")), "mis")
    edges = staged(edges.select("src", "dst"), "mis-edges")
    for _ in range(max_rounds):
        open_nodes = state.where("centre is null")
        if open_nodes.isEmpty():
            return state
        left = edges.join(open_nodes.select(F.col("idx").alias("src")), "src").join(open_nodes.select(F.col("idx").alias("dst"), F.col("pri").alias("other")), "dst")
        best = left.groupBy("src").agg(F.max("other").alias("best"))
        picked = open_nodes.join(best, open_nodes.idx == best.src, "left").where("best is null or pri > best").select("idx")
        picked = staged(picked, "mis-picked")
        out = edges.join(picked.select(F.col("idx").alias("src")), "src").select(F.col("dst").alias("idx")).distinct()
        marks = picked.withColumn("mark", F.lit(True)).union(out.withColumn("mark", F.lit(False))).groupBy("idx").agg(F.max("mark").alias("mark"))
        state = staged(state.join(marks, "idx", "left").select("idx", "pri", F.coalesce("centre", "mark").alias("centre")), "mis")
    raise RuntimeError(f"independent set did not settle in {max_rounds} rounds")
