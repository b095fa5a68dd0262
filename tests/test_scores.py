import math

import pytest

from thicket.model import members_of
from thicket.operators import report
from thicket.operators.representatives import rank, representatives

from . import helpers as h

R = {(0, 1): 0.1, (0, 2): 0.1, (0, 3): 1.0, (1, 2): 0.6, (1, 3): 0.6, (2, 3): 0.6}
R5 = R | {(0, 4): 0.9, (1, 4): 0.7, (2, 4): 0.8, (3, 4): 0.2}
TWO = {(0, 1): 0.2, (2, 3): 0.2}


def assigned(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "idx bigint, label int")


def members(spark, *clusters):
    return spark.createDataFrame([(k, p, i) for k, c in enumerate(clusters) for p, i in enumerate(c)], "label int, pos int, idx bigint")


def test_methods(spark):
    p, m = h.pair_frame(spark, R, 4), members(spark, [0, 1, 2, 3])
    best = lambda **o: rank(m, p, **o).where("rank = 1").first()["idx"]
    assert best() == 0 and best(method="minimax") == 1 and best(method="highest_neighborhood", threshold=0.2) == 0
    meta = spark.createDataFrame([(1, 0.4)], "idx bigint, priority double")
    row = rank(m, p, "weighted", metadata=meta).where("rank = 1").first()
    assert row["idx"] == 1 and row["score"] == pytest.approx(1.3 / 3 - 0.4)
    with pytest.raises(ValueError):
        rank(m, p, "highest_neighborhood")


def test_metrics(spark):
    meta = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B"), (4, "x")], "idx bigint, scaffold string")
    rows = rank(members(spark, [0, 1, 2, 3]), h.pair_frame(spark, R5, 5), threshold=0.2, metadata=meta).orderBy("rank").collect()
    assert [r["idx"] for r in rows] == [0, 1, 2, 3]
    want = {"score": 0.4, "mean": 0.4, "max": 1.0, "median": 0.1, "neighbor_fraction": 0.75, "nearest_external": 0.9, "radius": 1.0, "diameter": 1.0, "silhouette_like": 5 / 9, "scaffold_purity": 0.5}
    assert {k: rows[0][k] for k in want} == pytest.approx(want)
    one = rank(members(spark, [0, 1]), h.pair_frame(spark, {(0, 1): 0.1}, 2)).orderBy("rank").first()
    assert math.isnan(one["neighbor_fraction"]) and math.isinf(one["nearest_external"]) and one["silhouette_like"] == 1 and math.isnan(one["scaffold_purity"])


def test_selection(spark):
    p, m = h.pair_frame(spark, {(0, 1): 0.1, (2, 3): 0.2}, 4, 0.8), members(spark, [0, 1, 2, 3])
    picks = lambda s: [(r["idx"], r["rank"]) for r in representatives(m, p, 2, s).orderBy("step").collect()]
    assert picks("score") == [(0, 1), (1, 2)] and picks("diversity") == [(0, 1), (2, 3)]


def one(spark, labels, rows=TWO, default=0.8, **options):
    return report.report(assigned(spark, labels), h.pair_frame(spark, rows, 4, default), **options).first().asDict()


def test_report_of_two_clusters(spark):
    r = one(spark, [0, 0, 1, 1], boundary_threshold=0.3)
    want = {"num_samples": 4, "num_clusters": 2, "num_noise": 0, "num_singletons": 0, "largest_cluster_fraction": 0.5, "cluster_size_median": 2, "cluster_size_p90": 2, "size_gini": 0, "size_entropy": 1}
    want |= {"mean_intra_distance": 0.2, "median_intra_distance": 0.2, "median_radius": 0.2, "p95_diameter": 0.2, "silhouette": 0.75, "dunn_index": 4, "boundary_violations": 0}
    want |= {"median_medoid_member_distance": 0.2, "representative_redundancy": 0.8}
    assert {k: r[k] for k in want} == pytest.approx(want)
    assert r["coverage_at"] == [1, 1, 1]
    assert one(spark, [0, 0, 1, 1], boundary_threshold=0.9)["boundary_violations"] == 4


def test_report_edges(spark):
    r = one(spark, [0, 0, 0, 1], {}, 0.5)
    assert r["num_singletons"] == 1 and r["largest_cluster_fraction"] == 0.75 and r["size_gini"] == pytest.approx(0.25)
    assert r["size_entropy"] == pytest.approx(-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)))
    r = one(spark, [0, 0, -1, -1], coverage_thresholds=(0.3,))
    assert r["noise_fraction"] == 0.5 and r["singleton_fraction"] == pytest.approx(2 / 3) and r["coverage_at"] == [0.5]
    assert one(spark, [0, 0, -1, -1], treat_noise_as_singletons=False)["singleton_fraction"] == 0
    r = one(spark, [0, 0, 0, 0])
    assert math.isnan(r["silhouette"]) and math.isnan(r["dunn_index"]) and not math.isnan(r["median_radius"])
    r = one(spark, [-1, -1, -1, -1])
    assert r["coverage_at"] == [] and math.isnan(r["median_radius"]) and r["num_clusters"] == 0
    with pytest.raises(ValueError):
        report.options(boundary_threshold=-1)
    with pytest.raises(TypeError):
        report.options(other=1)


def test_compare(spark):
    p = h.pair_frame(spark, TWO, 4, 0.8)
    a = report.report(assigned(spark, [0, 0, 1, 1]), p)
    b = report.report(assigned(spark, [0, 0, -1, -1]), p, coverage_thresholds=(0.25,))
    table = report.compare({"one": a, "two": b})
    rows = {r["metric"]: r for r in table.collect()}
    assert math.isnan(rows["coverage_at[0.45]"]["two"]) and rows["num_noise"]["two"] == 2
    assert report.to_text(table).splitlines()[0].split() == ["metric", "one", "two"]
    with pytest.raises(ValueError):
        report.compare({"one": a})


def test_members_keep_order(spark):
    assert [r["idx"] for r in members_of(assigned(spark, [1, 0, 1, -1])).orderBy("label", "pos").collect()] == [1, 0, 2]
