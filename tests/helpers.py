"""Small frames, and plain Python versions of what the operators compute."""

import math
import random

from thicket.model import PairFrame


def pair_frame(spark, rows, n, default=None, **options):
    """rows: {(i, j): d}; default fills the other pairs."""
    full = {(i, j): rows.get((i, j), default) for i in range(n) for j in range(i + 1, n)}
    data = [(i, j, float(d)) for (i, j), d in full.items() if d is not None]
    return PairFrame(spark.createDataFrame(data, "i bigint, j bigint, d double"), n, "test", **options)


def random_pairs(seed, n, levels=6):
    r = random.Random(seed)
    return {(i, j): r.randint(1, levels) / levels for i in range(n) for j in range(i + 1, n)}


def dist(rows, i, j):
    return 0.0 if i == j else rows[min(i, j), max(i, j)]


def butina(rows, n, t):
    near = {i: [j for j in range(n) if j != i and dist(rows, i, j) <= t] for i in range(n)}
    left, out = set(range(n)), []
    for i in sorted(range(n), key=lambda i: (-len(near[i]), -i)):
        if i in left:
            cluster = [i, *[j for j in near[i] if j in left]]
            left -= set(cluster)
            out.append(tuple(cluster))
    return out


def butina_reordered(rows, n, t):
    near = {i: [j for j in range(n) if j != i and dist(rows, i, j) <= t] for i in range(n)}
    left, out = set(range(n)), []
    while left:
        i = max(left, key=lambda i: (sum(j in left for j in near[i]), i))
        cluster = [i, *[j for j in near[i] if j in left]]
        left -= set(cluster)
        out.append(tuple(cluster))
    return out


def dbscan(rows, n, eps, least):
    near = {i: [j for j in range(n) if dist(rows, i, j) <= eps] for i in range(n)}
    core = [i for i in range(n) if len(near[i]) >= least]
    labels, k = [-1] * n, 0
    for i in core:
        if labels[i] < 0:
            stack = [i]
            labels[i] = k
            while stack:
                for j in near[stack.pop()]:
                    if j in core and labels[j] < 0:
                        labels[j] = k
                        stack.append(j)
            k += 1
    for i in range(n):
        if labels[i] < 0 and (found := [labels[j] for j in near[i] if j in core]):
            labels[i] = min(found)
    return labels, core


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))


def clusters(result):
    found = {}
    for r in result.members.orderBy("label", "pos").collect():
        found.setdefault(r["label"], []).append(r["idx"])
    return [tuple(found[k]) for k in sorted(found)]


def labels(result):
    return [r["label"] for r in result.assignments.orderBy("idx").collect()]
