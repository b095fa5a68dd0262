import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.cli import run
from thicket.functions import fingerprints, metrics, selection
from thicket.model import condensed_pair, clusters_from_labels
from thicket.operators import pairs
from thicket.operators.hierarchy import bitbirch, bitbirch_parallel, bitbirch_refine
from thicket.operators.superpose import kabsch
from thicket.sources import files

from . import helpers as h


def bit_items(spark, rows, size):
    df = spark.createDataFrame(list(enumerate(rows)), "idx bigint, bits string")
    return df.select("idx", fingerprints.bit_words("bits", size).alias("words")).withColumn("popcount", fingerprints.popcount("words", (size + 63) // 64))


def random_bits(seed, n, size, density=0.2):
    r = random.Random(seed)
    return ["".join("1" if r.random() < density else "0" for _ in range(size)) for _ in range(n)]


def test_metrics_and_cutoff(spark):
    items = bit_items(spark, ["110", "011", "111"], 3)
    s = {(r["i"], r["j"]): r["d"] for r in pairs.pdist(items, metrics.fingerprint("tanimoto", True), "fp", "similarity").df.collect()}
    d = {(r["i"], r["j"]): r["d"] for r in pairs.pdist(items, metrics.fingerprint("jaccard"), "fp").df.collect()}
    assert s[0, 1] == pytest.approx(1 / 3) and all(s[k] + d[k] == pytest.approx(1) for k in s)
    cut = pairs.pdist(items, metrics.fingerprint("jaccard"), "fp", cutoff=0.4)
    assert cut.df.count() == 2 and not cut.complete
    for bad in ("cosine", "euclidean", "x"):
        with pytest.raises(ValueError):
            metrics.fingerprint(bad)
    with pytest.raises(ValueError):
        metrics.fingerprint("dice", True)
    with pytest.raises(ValueError):
        pairs.pdist(items, metrics.fingerprint("tanimoto", True), "fp", "similarity", cutoff=0.5)


def test_all_pairs_whatever_the_blocks(spark):
    df = spark.range(600).select(F.col("id").alias("idx"), (F.col("id") / 600).alias("x"))
    p = pairs.pdist(df, metrics.numeric(), "mock")
    assert p.df.count() == p.num_pairs == 600 * 599 // 2
    assert p.df.distinct().count() == p.num_pairs and p.df.where("i >= j").count() == 0
    for k in (0, 1, 598, 599, 5000, p.num_pairs - 1):
        i, j = condensed_pair(k, 600)
        assert 600 * i - i * (i + 1) // 2 + j - i - 1 == k and i < j < 600
    assert [r["k"] for r in p.condensed().orderBy("k").limit(3).collect()] == [0, 1, 2]
    kernel = pairs.pdist_kernel(df, lambda a, b: np.abs(a["x"].to_numpy()[:, None] - b["x"].to_numpy()[None, :]), "mock", ["x"])
    assert kernel.df.exceptAll(p.df).count() == 0 and kernel.df.count() == p.num_pairs
    cross = pairs.cdist(df.where("idx < 3"), df.where("idx < 5"), metrics.numeric())
    assert cross.count() == 15
    zeroed = pairs.cdist_zeroed(df.where("idx < 3"), df.where("idx < 5"), metrics.numeric(), 0.003)
    assert zeroed.count() == 15 and zeroed.where("d > 0.003").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_similarity_join_is_exact(spark, seed):
    items = bit_items(spark, random_bits(seed, 80, 100, 0.1) + ["0" * 100], 100)
    want = pairs.pdist(items, metrics.fingerprint("tanimoto", n_words=2), "fp").df.where("d <= 0.7 and not isnan(d)")
    got = pairs.similarity_join(items, 0.7, 100, 2).df
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_sums(spark):
    items = bit_items(spark, ["1010", "1000"], 4).withColumn("g", F.lit("a"))
    sums = fingerprints.linear_sums(items, 4, "g")
    assert [r["sum"] for r in sums.orderBy("bit").collect()] == [2, 0, 1, 0]
    assert [r["bit_set"] for r in fingerprints.binary_centroids(sums).orderBy("bit").collect()] == [1, 0, 1, 0]


def test_bitbirch_in_spark(spark):
    rows = ["1100", "1100", "0011", "0011"]
    found = bitbirch(bit_items(spark, rows, 4), 4, 0.75, 2)
    assert h.labels(found) == [0, 0, 1, 1]
    assert sorted(h.labels(bitbirch_parallel(bit_items(spark, rows * 10, 4), 4, 0.75, parts=3))) == [0] * 20 + [1] * 20
    with pytest.raises(ValueError):
        bitbirch_refine(bit_items(spark, rows, 4), 4, singly=True, redistribute_largest_cluster=True)


def test_labels_to_clusters_keep_empty(spark):
    a = spark.createDataFrame([(0, 2), (1, 0), (2, -1)], "idx bigint, label int")
    assert [list(r["idxs"]) for r in clusters_from_labels(a).orderBy("label").collect()] == [[1], [], [0]]


def test_files(spark, tmp_path):
    p = h.pair_frame(spark, {(0, 1): 0.25, (0, 2): 0.5, (1, 2): 0.125}, 3)
    for kind in ("npy", "csv", "bin"):
        files.write_pdist(p, str(tmp_path / f"m.{kind}"))
    raw = (tmp_path / "m.npy").read_bytes()
    assert raw[6:8] == b"\x01\x00" and (10 + int.from_bytes(raw[8:10], "little")) % 64 == 0
    assert np.load(tmp_path / "m.npy").tolist() == [0.25, 0.5, 0.125] == np.fromfile(tmp_path / "m.bin").tolist()
    assert (tmp_path / "m.csv").read_text().splitlines()[:2] == [",item_0,item_1,item_2", "item_0,0,0.25,0.5"]
    assert json.loads((tmp_path / "m.json").read_text())["n_rows"] == 3
    with pytest.raises(ValueError):
        files.write_pdist(p, str(tmp_path / "m.xyz"))
    cut = p.cut(0.3)
    files.save_npz(cut, str(tmp_path / "m.npz"))
    files.save_pairs(cut, str(tmp_path / "saved"))
    for back in (files.load_npz(spark, str(tmp_path / "m.npz")), files.load_pairs(spark, str(tmp_path / "saved"))):
        assert (back.n, back.complete, back.cutoff, back.df.count()) == (3, False, 0.3, 2)


def test_smiles_and_sdf(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol\n\n# x\nc1ccccc1\n")
    assert [r["label"] for r in files.read_smiles(spark, str(tmp_path / "a.smi")).orderBy("idx").collect()] == ["ethanol", "mol_1"]
    (tmp_path / "a.sdf").write_text("name\n\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    1.0000    2.0000    3.0000 C   0  0\nM  END\n$$$$\n")
    molecules, atoms = files.read_sdf(spark, str(tmp_path / "a.sdf"))
    assert molecules.first()["label"] == "name" and [atoms.first()[c] for c in ("element", "x", "y", "z")] == ["C", 1, 2, 3]
    assert files.is_maestro("x.MAEGZ") and not files.is_maestro("x.sdf")


ATOMS = [
    (0, 0, "N", "ALA", 1, "A", "", "N", 0.0, 0.0, 0.0),
    (0, 1, "CA", "ALA", 1, "A", "", "C", 1.5, 0.0, 0.0),
    (0, 2, "CB", "ALA", 1, "A", "", "C", 2.0, 1.0, 0.0),
    (0, 3, "O", "HOH", 2, "A", "", "O", 4.0, 0.0, 0.0),
    (0, 4, "C1", "LIG", 3, "B", "", "C", 10.0, 0.0, 0.0),
    (0, 5, "H1", "LIG", 3, "B", "", "H", 11.0, 0.0, 0.0),
]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("protein and backbone", [0, 1]),
        ("name C*", [1, 2, 4]),
        ("resi 1-2 and not water", [0, 1, 2]),
        ("water or ligand", [3, 4, 5]),
        ("ligand and heavy", [4]),
        ("by_res name CA", [0, 1, 2]),
        ("around 3 of water", [1, 2]),
        ("expand 3 of water", [1, 2, 3]),
        ("beyond 5 of protein", [4, 5]),
        ("chain A xor water", [0, 1, 2]),
        ("index >= 4", [4, 5]),
        ("", [0, 1, 2, 3, 4, 5]),
    ],
)
def test_selection(spark, text, expected):
    atoms = spark.createDataFrame(ATOMS, "idx bigint, atom int, name string, resn string, resi int, chain string, icode string, elem string, x double, y double, z double")
    assert [r["atom"] for r in selection.select(atoms, text).orderBy("atom").collect()] == expected


def test_selection_errors_and_tree():
    for bad in ("name", "(protein", "protein and", "frob 3", "resi x"):
        with pytest.raises(ValueError):
            selection.parse(bad)
    tree = selection.parse("not (name CA or water)")
    assert selection.parse(tree.canonical()) == tree and tree.contains("water")


def test_kabsch():
    a = np.random.default_rng(0).normal(size=(8, 3))
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert kabsch(a, a @ turn + 3) == pytest.approx(0, abs=1e-6) and kabsch(a, a[:, [1, 0, 2]]) > 0.1


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(list(enumerate(["1100", "0110", "1111"])), "idx bigint, bits string").write.parquet(str(tmp_path / "in.parquet"))
    assert run(spark, ["fp", str(tmp_path / "in.parquet"), "-o", str(tmp_path / "o.npy"), "--numbits", "4"]) == 0
    assert np.load(tmp_path / "o.npy").tolist() == pytest.approx([2 / 3, 0.5, 0.5])
    assert run(spark, ["fp", str(tmp_path / "in.parquet"), str(tmp_path / "in.parquet"), "-o", str(tmp_path / "o.csv"), "--numbits", "4"]) == 0
    assert run(spark, ["fp", str(tmp_path / "in.parquet"), "-o", str(tmp_path / "o.npy"), "--metric", "cosine"]) == 1
    assert "error:" in capsys.readouterr().err


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_token_sets(spark, monkeypatch, heavy):
    """Every link between different sets, and classes of equal ones, against all pairs."""
    monkeypatch.setattr(pairs, "HEAVY", heavy)
    r = random.Random(6)
    base = [[f"w{r.randrange(40)}" for _ in range(r.randint(1, 14))] for _ in range(25)]
    rows = [(k, [w for w in x if r.random() < 0.93]) for k, x in enumerate(base * 3)] + [(100, base[0][::-1]), (101, base[0] * 2), (102, []), (103, []), (104, None)]
    links, members = pairs.token_jaccard(spark.createDataFrame(rows, "doc bigint, tok array<string>"), "doc", "tok", 0.6)
    sets = {k: frozenset(x or ()) for k, x in rows}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    first = {k: min([j for j in sets if sets[j] == sets[k] and sets[k]] or [k]) for k in sets}
    assert {x["idx"]: (x["class_id"], x["class_size"]) for x in members.collect()} == {k: (first[k], sum(f == first[k] for f in first.values())) for k in sets}
    tops = sorted(set(first.values()))
    want = {(i, j): jac(sets[i], sets[j]) for i in tops for j in tops if i < j and jac(sets[i], sets[j]) >= 0.6}
    assert {(x["i"], x["j"]): x["jaccard"] for x in links.collect()} == pytest.approx(want) and want
    got = {x["idx"]: x["n_links"] for x in pairs.link_counts(links, members).collect()}
    assert got == {k: sum(j != k and jac(sets[j], sets[k]) >= 0.6 for j in sets) for k in sets}


def test_token_jaccard_orders_tokens_of_every_frequency(spark, monkeypatch):
    """Tokens of middling frequency stay out of prefixes that rarer ones fill."""
    monkeypatch.setattr(pairs, "HEAVY", 3, raising=False)
    docs = [(k, [f"own{k}-{x}" for x in range(4)] + [f"mid{x}" for x in range(4)] + [f"all{x}" for x in range(3)]) for k in range(50)]
    docs += [(k, [f"all{x}" for x in range(3)] + [f"odd{k}-{x}" for x in range(2)]) for k in range(50, 80)] + [(80, docs[0][1][1:])]
    seen, staged = {}, pairs.staged
    monkeypatch.setattr(pairs, "staged", lambda df, tag, **options: seen.setdefault((tag, len(seen)), staged(df, tag, **options)))
    links, _ = pairs.token_jaccard(spark.createDataFrame(docs, "id long, tok array<string>"), "id", "tok", 0.8)
    assert [(r["i"], r["j"], round(r["jaccard"], 6)) for r in links.collect()] == [(0, 80, round(10 / 11, 6))]
    assert max(r["count"] for r in next(df for (tag, _), df in seen.items() if tag == "prefixes").groupBy("t").count().collect()) == 2
