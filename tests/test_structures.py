"""Molecules, progress, stores, kernels and the command line."""

import json

import numpy as np
import pytest

from thicket import cli
from thicket.functions import metrics, selection, structures
from thicket.model import ClusterEngineError
from thicket.operators import pairs, report
from thicket.operators.progress import with_progress
from thicket.operators.representatives import rank, validate_members, validate_metadata
from thicket.sources import files

from . import helpers as h
from .test_scores import TWO, assigned, members

ASPIRIN, CAFFEINE = "CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"


def test_smiles_are_read():
    atoms = structures.parse(ASPIRIN)
    assert [a.symbol for a in atoms] == list("CCOOCCCCCCCOO") and sum(a.hydrogens for a in atoms) == 8
    assert sum(len(a.bonds) for a in atoms) == 2 * 13 and len(structures._ring_bonds(atoms)) == 6
    assert sum(a.hydrogens for a in structures.parse(CAFFEINE)) == 10
    salt = structures.parse("[Na+].[13CH3][C@@H](N)C(=O)[O-]")
    assert (salt[0].charge, salt[1].mass, salt[1].hydrogens, salt[2].hydrogens, salt[-1].charge) == (1, 13, 3, 1, -1) and not salt[0].bonds
    assert len(structures.parse("C%10CCCCC%10")[0].bonds) == 2 and structures.parse("F/C=C\\F")[1].bonds[1][1] == 2
    assert [a.hydrogens for a in structures.parse("C#N")] == [1, 0] and structures.parse("Clc1ccc[nH]1")[-1].hydrogens == 1
    for bad in ("C1CC", "C(C", "C)C", "Qx", "[C", "1CC", "[12]"):
        with pytest.raises(ValueError):
            structures.parse(bad)


@pytest.mark.parametrize("f", [structures.morgan, structures.atom_pairs])
def test_fingerprints_do_not_hang_on_the_writing(f):
    for one, other in (("CCO", "OCC"), (ASPIRIN, "O=C(C)Oc1c(C(O)=O)cccc1"), ("C1CCCCC1N", "NC1CCCCC1"), (CAFFEINE, "CN1C=NC2=C1C(=O)N(C(=O)N2C)C".replace("N1C=NC2=C1C", "n1cnc2c1c").replace("(=O)N(C(=O)N2C)C", "(=O)n(C)c(=O)n2C"))):
        assert f(structures.parse(one)) == f(structures.parse(other))
    assert f(structures.parse("CCO")) != f(structures.parse("CCN"))
    # a wider reach adds environments and takes none away
    narrow, wide = (f(structures.parse(ASPIRIN), max_d) if f is None else (structures.morgan(structures.parse(ASPIRIN), 1 << 40, max_d) if f is structures.morgan else structures.atom_pairs(structures.parse(ASPIRIN), 1 << 40, 0, max_d)) for max_d in (1, 3))
    assert narrow < wide


def test_atom_pairs_by_distance():
    chain = structures.parse("CCCO")
    count = lambda a, b: len(structures.atom_pairs(chain, 1 << 40, a, b))
    assert count(3, 3) == 1 and count(1, 1) == 3 and count(0, 0) == 3  # kinds: CH3, CH2 (twice), O


def test_molecules_in_spark(spark, tmp_path):
    (tmp_path / "a.smi").write_text(f"# names\n{ASPIRIN} aspirin\n{CAFFEINE}\n\nO=C(C)Oc1ccccc1C(O)=O again\nCCO ethanol\n")
    df = files.read_smiles(spark, str(tmp_path / "a.smi"))
    for kind in ("morgan", "atom_pair", "AtomPair"):
        items = structures.molecule_fingerprints(df, kind=kind, numbits=512)
        d = {(r["i"], r["j"]): r["d"] for r in pairs.pdist(items, metrics.fingerprint("tanimoto", n_words=8), "fingerprint").df.collect()}
        assert d[0, 2] == 0 and d[0, 1] > 0.5 and d[0, 3] > 0.5
        assert all(r["popcount"] == sum(bin(w & (1 << 64) - 1).count("1") for w in r["words"]) for r in items.collect())
    for kind in ("maccs", "tree", "other"):
        with pytest.raises(ClusterEngineError):
            structures.molecule_fingerprints(df, kind=kind)
    with pytest.raises(Exception, match="molecule 1"):
        structures.molecule_fingerprints(spark.createDataFrame([(0, "CC"), (1, "C1C")], "idx bigint, smiles string")).collect()
    assert cli.run(spark, ["fp", str(tmp_path / "a.smi"), "-o", str(tmp_path / "m.npy"), "--fp-type", "atompair", "--max-distance", "3"]) == 0
    assert np.load(tmp_path / "m.npy").size in (6, 16)
    assert cli.run(spark, ["fp", str(tmp_path / "a.smi"), str(tmp_path / "a.smi"), "-o", str(tmp_path / "x.npy"), "--no-progress", "-v"]) == 0
    assert np.load(tmp_path / "x.npy").shape == (4, 4)
    assert cli.run(spark, ["fp", str(tmp_path / "a.smi"), "-o", str(tmp_path / "y.npy"), "--fp-type", "maccs", "--no-progress"]) == 1


def test_overlay_scores_on_the_command_line(spark, tmp_path):
    spark.createDataFrame([(0, 1, 1.5), (0, 2, 0.5), (1, 2, 2.0)], "i bigint, j bigint, score double").write.parquet(str(tmp_path / "s"))
    assert cli.run(spark, ["rocs", str(tmp_path / "s"), "-o", str(tmp_path / "d.parquet"), "--score", "combo", "--no-progress"]) == 0
    found = files.load_pairs(spark, str(tmp_path / "d.parquet"))
    assert {(r["i"], r["j"]): r["d"] for r in found.df.collect()} == {(0, 1): 0.5, (0, 2): 1.5, (1, 2): 0.0} and found.n == 3
    with pytest.raises(Exception):
        spark.range(1).select(metrics.superposition_score("global", metrics.F.lit(-1.0))).collect()
    row = spark.range(1).select(metrics.shape_score("combo_norm", metrics.F.lit(1.0)).alias("a"), metrics.shape_score("color", metrics.F.lit(0.25), True).alias("b"), metrics.superposition_score("sse", metrics.F.lit(0.25)).alias("c")).first()
    assert tuple(row) == (0.5, 0.25, 0.75)


def test_progress(spark):
    seen = []
    n = with_progress(spark, lambda: spark.range(0, 1000, 1, 7).selectExpr("sum(id)").first()[0], lambda done, total: seen.append((done, total)), 0.01)
    assert n == 499500 and seen[-1][0] == seen[-1][1] > 0
    assert [d for d, _ in seen] == sorted(d for d, _ in seen) and all(d <= t for d, t in seen)
    with pytest.raises(ZeroDivisionError):
        with_progress(spark, lambda: 1 / 0, lambda done, total: None)


def test_cross_kernel(spark):
    a, b = (spark.createDataFrame([(k, float(k * s)) for k in range(n)], "idx bigint, x double") for n, s in ((300, 1), (7, 2)))
    got = {(r["i"], r["j"]): r["d"] for r in pairs.cdist_kernel(a, b, lambda x, y: np.abs(x["x"].to_numpy()[:, None] - y["x"].to_numpy()[None, :]), ["x"]).collect()}
    assert got == {(i, j): abs(float(i - 2 * j)) for i in range(300) for j in range(7)}


def test_stores(spark, tmp_path):
    p = h.pair_frame(spark, TWO, 4, 0.8)
    labels = spark.createDataFrame([(k, f"m{k}") for k in range(4)], "idx bigint, label string")
    named = type(p)(p.df, p.n, p.comparison, p.kind, p.complete, p.cutoff, p.params, labels)
    path = str(tmp_path / "store")
    files.save_pairs(named, path)
    assert {r["idx"]: r["label"] for r in files.load_pairs(spark, path).labels.collect()} == {k: f"m{k}" for k in range(4)}
    grown = files.grow_pairs(spark, path, spark.createDataFrame([(k, 4, 0.3) for k in range(4)], "i bigint, j bigint, d double"), 5, complete=True)
    assert grown.n == 5 and grown.complete and grown.df.count() == 10
    with pytest.raises(ClusterEngineError):
        files.grow_pairs(spark, path, p.df, 3)
    folder = tmp_path / "own"
    folder.mkdir()

    def writer(batches):
        import os
        import uuid

        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            with open(os.path.join(str(folder), uuid.uuid4().hex), "w") as f:
                json.dump(rows, f)

    assert files.write_with(p, writer) == 6
    assert sorted((r["i"], r["j"]) for f in folder.iterdir() for r in json.loads(f.read_text())) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_members_and_metadata_are_checked(spark):
    p = h.pair_frame(spark, TWO, 4, 0.8)
    for bad in ([0, 1, 1], [0, 9], [-1, 0]):
        with pytest.raises(ValueError):
            rank(members(spark, bad), p)
    with pytest.raises(ValueError, match="empty"):
        validate_members(spark.createDataFrame([(0, 0, None)], "label int, pos int, idx bigint"), 4)
    for rows in ([(0, 0.1), (0, 0.2)], [(7, 0.1)]):
        with pytest.raises(ValueError):
            rank(members(spark, [0, 1]), p, "weighted", metadata=spark.createDataFrame(rows, "idx bigint, priority double"))
    validate_metadata(None, 3)


def test_the_order_of_rows_does_not_matter(spark):
    r = h.random_pairs(5, 12, 7)
    p, m = h.pair_frame(spark, r, 12), members(spark, list(range(12)))
    want = [x["idx"] for x in rank(m, p).orderBy("rank").collect()]
    for parts in (1, 3, 5):
        mixed = type(p)(p.df.orderBy(p.df.d.desc()).repartition(parts), p.n, p.comparison)
        assert [x["idx"] for x in rank(m, mixed).orderBy("rank").collect()] == want


def test_a_card_can_only_be_read(spark):
    card = report.card(report.report(assigned(spark, [0, 0, 1, 1]), h.pair_frame(spark, TWO, 4, 0.8)))
    assert card.num_clusters == 2 and card.coverage_at == (1.0, 1.0, 1.0) and card.to_dict()["silhouette"] == card.silhouette
    with pytest.raises(AttributeError):
        card.num_clusters = 3
    with pytest.raises(AttributeError):
        card.nothing
    with pytest.raises(TypeError):
        card.values["num_clusters"] = 3


def test_selectors_of_structures(spark):
    rows = [(0, 0, "ALA", 1, None, "A"), (0, 1, "ALA", 1, None, "A"), (0, 2, "GLY", 2, "B", "A"), (1, 0, None, 5, None, None)]
    atoms = spark.createDataFrame(rows, "idx bigint, atom int, resn string, resi int, icode string, chain string")
    assert {r["idx"]: r["selectors"] for r in selection.structure_selectors(atoms).collect()} == {0: ["ALA:1: :A", "GLY:2:B:A"], 1: [":5: : "]}
    assert selection.is_empty("  ") and not selection.is_empty("all")
