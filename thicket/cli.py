"""python -m thicket.cli fp|vector|superpose|rocs INPUT [INPUT2] -o OUT: distances of the items of tables or files.

fp: a file of SMILES (.smi, .smiles), or a column of bit strings or of vectors (sign bits) of Parquet; vector: a column of
numbers; superpose: atoms of structures; rocs: overlay scores (i, j, score) made elsewhere, as distances or similarities.
A second input gives the cross distances.  OUT ends in .npy, .csv, .bin or .parquet.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fingerprints, metrics
from .functions.structures import molecule_fingerprints
from .model import PairFrame
from .operators import pairs
from .operators.progress import with_progress
from .operators.superpose import rmsd_metric, structures
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thicket", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("fp", "vector", "superpose", "rocs"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("input2", nargs="?")
        s.add_argument("-o", "--output", required=True)
        s.add_argument("-c", "--cutoff", type=float)
        s.add_argument("--order", default="idx", help="column that orders the items")
        s.add_argument("--sim", action="store_true", help="similarities instead of distances")
        s.add_argument("-t", "--threads", type=int, default=0, help="tasks at a time, where no session exists yet")
        s.add_argument("--chunk-size", type=int, default=pairs.BLOCK, help="items of a block")
        s.add_argument("--no-progress", action="store_true")
        s.add_argument("-v", "--verbose", action="store_true")
        if name == "rocs":
            s.add_argument("--score", default="combo_norm", choices=["combo_norm", "combo", "shape", "color"])
            continue
        s.add_argument("--metric", default={"fp": "tanimoto", "vector": "euclidean", "superpose": "rmsd"}[name])
        if name == "superpose":
            s.add_argument("--method", default="kabsch", choices=["kabsch", "ddm"])
            s.add_argument("--predicate", default="")
            s.add_argument("--ref-predicate")
            s.add_argument("--fit-predicate")
        else:
            s.add_argument("--column", default={"fp": "bits", "vector": "vector"}[name])
            s.add_argument("--numbits", type=int, default=0, help="2048 for molecules, 64 otherwise")
        if name == "fp":
            s.add_argument("--fp-type", default="morgan", help="morgan or atom_pair")
            s.add_argument("--min-distance", type=int, default=0)
            s.add_argument("--max-distance", type=int, default=2)
    return p


def _smiles(path: str) -> bool:
    return path.lower().endswith((".smi", ".smiles", ".smi.gz"))


def _items(spark: SparkSession, a: argparse.Namespace, path: str, side: str | None = None) -> DataFrame:
    if a.command == "fp" and (_smiles(path) or files.is_maestro(path)):
        return molecule_fingerprints(files.read_smiles(spark, path), "smiles", a.fp_type, a.numbits, a.min_distance, a.max_distance)
    df = spark.read.parquet(path)
    if a.command == "superpose":
        return structures(df, a.predicate if side is None else side)
    if a.command == "fp" and dict(df.dtypes)[a.column] == "string":
        df = df.withColumn("_v", F.transform(F.split(a.column, ""), lambda c: (c == "1").cast("int")))
        return fingerprints.fingerprints(df, "_v", a.numbits, a.order)
    if a.command == "fp":
        return fingerprints.fingerprints(df, a.column, a.numbits, a.order)
    from .operators.ranking import dense_index

    return dense_index(df.select(F.col(a.order).alias("_o"), F.col(a.column).cast("array<double>").alias("vector")), "idx", "_o").select("idx", "vector")


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    usual = pairs.BLOCK
    try:
        if a.chunk_size < 1:
            raise ValueError("--chunk-size must be at least 1")
        pairs.BLOCK = a.chunk_size
        if a.no_progress:
            _write(spark, a)
        else:
            with_progress(spark, lambda: _write(spark, a), lambda done, total: print(f"\r{done}/{total}", end="", file=sys.stderr))
            print(file=sys.stderr)
    except Exception as e:  # noqa: BLE001  the command line reports any failure in one line
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        pairs.BLOCK = usual
    return 0


def _scores(spark: SparkSession, a: argparse.Namespace) -> None:
    """Overlay scores of pairs as a frame of distances or similarities."""
    if a.input2:
        raise ValueError("rocs takes one table of scores")
    df = spark.read.parquet(a.input)
    n = df.agg(F.max(F.greatest("i", "j"))).first()[0]
    if n is None:
        raise ValueError(f"{a.input} has no items")
    d = metrics.shape_score(a.score, F.col("score"), a.sim)
    frame = PairFrame(df.select("i", "j", d.alias("d")), n + 1, "rocs", "similarity" if a.sim else "distance", params={"score": a.score})
    files.save_pairs(frame, a.output) if a.output.endswith(".parquet") else files.write_pdist(frame, a.output)


def _write(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "rocs":
        _scores(spark, a)
        return
    if hasattr(a, "numbits") and not a.numbits:
        a.numbits = 2048 if _smiles(a.input) else 64
    n_words = (getattr(a, "numbits", 64) + 63) // 64
    metric = metrics.fingerprint(a.metric, a.sim, n_words) if a.command == "fp" else metrics.vector(a.metric, a.numbits, similarity=a.sim) if a.command == "vector" else rmsd_metric(a.method)
    kind = "similarity" if a.sim and a.command != "superpose" else "distance"
    left = _items(spark, a, a.input, getattr(a, "ref_predicate", None) if a.input2 else None)
    n = left.count()
    if not n:
        raise ValueError(f"{a.input} has no items")
    if a.verbose:
        print(f"{n} items in {a.input}", file=sys.stderr)
    if a.input2:
        right = _items(spark, a, a.input2, getattr(a, "fit_predicate", None))
        m = right.count()
        if not m:
            raise ValueError(f"{a.input2} has no items")
        cross = pairs.cdist(left, right, metric, a.cutoff)
        if a.output.endswith(".parquet"):
            cross.write.mode("overwrite").parquet(a.output)
        else:
            files.write_cdist(cross, n, m, a.output, a.command, [f"item_{k}" for k in range(n)], [f"item_{k}" for k in range(m)], {"metric": a.metric})
    else:
        frame = pairs.pdist(left, metric, a.command, kind, a.cutoff, n, metric=a.metric)
        files.save_pairs(frame, a.output) if a.output.endswith(".parquet") else files.write_pdist(frame, a.output)


def session(argv: list[str]) -> SparkSession:
    threads = parser().parse_args(argv).threads
    builder = SparkSession.builder.appName("thicket")
    return (builder.master(f"local[{threads}]") if threads > 0 else builder).getOrCreate()


if __name__ == "__main__":
    sys.exit(run(session(sys.argv[1:]), sys.argv[1:]))
