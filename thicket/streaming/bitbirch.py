"""Incremental clustering of a stream of fingerprints: every key keeps its cluster counts between batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kernels


def cluster_stream(stream: DataFrame, size: int, key: str = "key", threshold: float = 0.65, branching_factor: int = 50) -> DataFrame:
    """(key, label, size, delta) after each batch, for the clusters that changed.  stream: key, idx, words.

    Only clusters' counts are kept, not their members, so a key's state grows with its clusters.  In every batch a tree
    is built from the known clusters, in their order, and the new items are inserted in order of idx; labels stay.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: list[tuple[int, np.ndarray]] = pickle.loads(state.get[0]) if state.exists else []
        tree = kernels.BitTree(threshold, branching_factor)
        for label, (n, sums) in enumerate(known):
            tree.insert(kernels.Summary(n, sums, kernels.centroid(sums, n), [label]))
        new = pd.concat(list(batches)).sort_values("idx")
        bits = np.unpackbits(np.array(new["words"].tolist(), dtype=np.int64).view(np.uint8).reshape(len(new), -1), axis=1, bitorder="little")[:, :size].astype(bool)
        for row in bits:
            tree.insert(kernels.Summary(1, row.astype(np.int64), row, []))
        # clusters of earlier batches may have met in one entry, which keeps the smallest label; entries without a
        # label are new and numbered on
        rows, after, fresh = [], {}, len(known)
        for _, s in tree.leaves():
            if s.members:
                label, before = min(s.members), sum(known[m][0] for m in s.members)
            else:
                label, before, fresh = fresh, 0, fresh + 1
            after[label] = (s.n, s.sums)
            if s.n != before or len(s.members) > 1:
                rows.append((*name, label, s.n, s.n - before))
        empty = np.zeros(size, dtype=np.int64)
        state.update((pickle.dumps([after.get(k, (0, empty)) for k in range(fresh)]),))
        yield pd.DataFrame(rows, columns=[key, "label", "size", "delta"])

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, label int, size bigint, delta bigint", "tree binary", "update", GroupStateTimeout.NoTimeout)
