"""Pairs of fingerprints and vectors in numpy against frames of their pairs, which have no fingerprints to fall back on."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest

from thicket.functions import fingerprints as fp
from thicket.functions import metrics
from thicket.model import PairFrame
from thicket.operators import butina, hierarchy, pairs, report

N = 70


def vectors(seed=3, n=N, empty=1):
    """Rows (vec_id, embedding, label): some copies, `empty` without a bit, two without a label."""
    r = random.Random(seed)
    rows = [[r.uniform(-1, 1) + (k % 3) * 0.3 for _ in range(64)] for k in range(n)]
    for k in range(10, 14):
        rows[k] = rows[10]
    for k in range(empty):
        rows[k] = [-1.0] * 64
    return [(k, v, None if k in (4, 5) else k % 4 if k % 9 else -1) for k, v in enumerate(rows)]


def items(spark, **options):
    return fp.fingerprints(spark.createDataFrame(vectors(**options), "vec_id long, embedding array<double>, label int"), "embedding", 64, "vec_id", "label")


def both(spark, metric="tanimoto", **options):
    """The frame with its fingerprints, and one of the same rows without."""
    x = items(spark, **options)
    known = pairs.pdist(x, metrics.fingerprint(metric), "fingerprint")
    return known, replace(pairs_by_blocks(x, metrics.fingerprint(metric), known.n), df=known.df.sparkSession.createDataFrame(pairs_by_blocks(x, metrics.fingerprint(metric), known.n).df.toArrow()))


def pairs_by_blocks(x, metric, n):
    from pyspark.sql import functions as F

    df = pairs.block_pairs(x, x, n, n, True)
    return PairFrame(df.select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), metric("a", "b").alias("d")), n, "fingerprint")


def rows(df):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def frames(spark):
    return both(spark)


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_hdbscan_beyond_a_matrix(spark, frames, monkeypatch, method):
    known, plain = frames
    want = hierarchy.hdbscan(plain, 5, 3, method=method, alpha=0.9)
    monkeypatch.setattr(hierarchy, "MATRIX_LIMIT", N - 1)
    found = hierarchy.hdbscan(known, 5, 3, method=method, alpha=0.9)
    assert rows(found.assignments) == rows(want.assignments)
    assert rows(found.extra["probabilities"]) == rows(want.extra["probabilities"])


def test_single_linkage_beyond_a_matrix(spark, frames, monkeypatch):
    known, plain = frames
    want = hierarchy.agglomerative(plain, None, 0.5, "single")
    monkeypatch.setattr(hierarchy, "MATRIX_LIMIT", N - 1)
    assert rows(hierarchy.agglomerative(known, None, 0.5, "single").assignments) == rows(want.assignments)


def test_butina_reordered_without_edges(spark, frames, monkeypatch):
    known, plain = frames
    want = butina.butina(plain, 0.55, reordering=True)
    monkeypatch.setattr(butina, "components", None)
    monkeypatch.setattr(PairFrame, "within", None)
    found = butina.butina(known, 0.55, reordering=True)
    assert rows(found.members) == rows(want.members)
    assert rows(found.extra["centres"]) == rows(want.extra["centres"])


FIGURES = {
    "boundary": lambda f: report.boundary(f, 0.6),
    "compactness": report.compactness,
    "coverage": lambda f: report.coverage(f, (0.4, 0.5, 0.6)),
    "dunn": report.dunn,
    "redundancy": report.redundancy,
    "silhouette": report.silhouette,
}


@pytest.mark.parametrize("name", FIGURES)
@pytest.mark.parametrize("empty", [1, 3])
def test_figures_write_no_pairs(spark, monkeypatch, name, empty):
    known, plain = both(spark, empty=empty)
    labels = items(spark, empty=empty).selectExpr("idx", "coalesce(label, -1) as label")
    want = FIGURES[name](report.frames(labels, plain)).collect()[0]
    written, staged = [], report.staged
    monkeypatch.setattr(report, "staged", lambda df, tag: written.append((tag, (out := staged(df, tag)).count())) or out)
    found = FIGURES[name](report.frames(labels, known)).collect()[0]
    assert np.allclose(np.array(found, float), np.array(want, float), atol=1e-12, equal_nan=True)
    assert "pairs" not in dict(written)
    assert max(c for _, c in written) < N * (N - 1) // 3


@pytest.mark.parametrize("empty", [1, 3])
def test_nearest_shuffles_no_pairs(spark, empty):
    known, plain = both(spark, empty=empty)
    assert rows(pairs.nearest(known, 5)) == rows(pairs.nearest(plain, 5))
    assert rows(pairs.nearest(known, 2 * N)) == rows(pairs.nearest(plain, 2 * N))
    assert rows(pairs.core_distances(known, 5)) == rows(pairs.core_distances(plain, 5))
    for df in (pairs.nearest(known, 5), pairs.core_distances(known, 5)):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "manhattan"])
def test_pairs_of_fingerprints_without_a_join(spark, metric):
    known, plain = both(spark, metric, empty=2)
    assert rows(known.rounded(9)) == rows(plain.rounded(9))
    assert rows(replace(known, df=known.rounded(9)).condensed()) == rows(replace(plain, df=plain.rounded(9)).condensed())
    assert rows(known.cut(0.5).df) == rows(plain.cut(0.5).df)
    assert "Join" not in plan(known.rounded(9))


def test_similarity_without_a_join(spark):
    x = items(spark, empty=2)
    known = pairs.pdist(x, metrics.fingerprint("tanimoto", True), "fingerprint", "similarity")
    assert rows(known.rounded(9)) == rows(pairs_by_blocks(x, metrics.fingerprint("tanimoto", True), N).rounded(9))
    assert "Join" not in plan(known.rounded(9))


def test_mutual_reachability_without_a_join(spark):
    known, plain = both(spark, empty=1)
    assert rows(pairs.mutual_reachability(known, 5, 9)) == rows(pairs.mutual_reachability(plain, 5, 9))
    assert "Join" not in plan(pairs.mutual_reachability(known, 5, 9))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pairs_of_vectors_without_a_join(spark, metric):
    data = [(k, [0.0] * 64 if k in (1, 2) else v) for k, v, _ in vectors()]
    data[20] = (20, [x + 1e-7 for x in data[10][1]])
    x = spark.createDataFrame(data, "idx long, vector array<double>")
    known = pairs.pdist(x, metrics.vector(metric, 64), "vector")
    assert rows(known.rounded(6)) == rows(pairs_by_blocks(x, metrics.vector(metric, 64), N).rounded(6))
    assert "Join" not in plan(known.rounded(6))


def test_items_that_do_not_fit_are_joined(spark, monkeypatch):
    from thicket.operators import packed

    monkeypatch.setattr(packed, "MOST_BYTES", 100)
    known = pairs.pdist(items(spark), metrics.fingerprint("tanimoto"), "fingerprint")
    assert known.source is None and "Join" in plan(known.df) and known.df.count() == N * (N - 1) // 2
