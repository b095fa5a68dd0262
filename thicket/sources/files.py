"""Reading items, and writing and reading distance matrices.

Scalable form: Parquet tables with a JSON sidecar (save_pairs, load_pairs).  The array formats (.npy, .csv, .bin, .npz)
hold one dense matrix, so they gather it on the driver and refuse more than MATRIX_LIMIT items.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MATRIX_LIMIT, ClusterEngineError, PairFrame

MAESTRO = (".mae", ".mae.gz", ".maegz")


def is_maestro(path: str) -> bool:
    return path.lower().endswith(MAESTRO)


def item_label(title: str, idx: str, prefix: str = "mol"):
    """An item's title or, without one, prefix_index."""
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit(f"{prefix}_"), F.col(idx).cast("string")))


def _numbered(df: DataFrame, order: str) -> DataFrame:
    from ..operators.ranking import dense_index

    return dense_index(df, "idx", order)


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(idx, smiles, title, label) of a text file with a SMILES and an optional title on each line; blank lines and
    lines that begin with # are left out."""
    if is_maestro(path):
        raise ClusterEngineError("Maestro files need a toolkit; convert them to SMILES or Parquet")
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split(F.trim("value"), r"\s+", 2)
    out = _numbered(lines.select("_at", parts[0].alias("smiles"), F.get(parts, F.lit(1)).alias("title")), "_at").drop("_at")
    return out.withColumn("label", item_label("title", "idx"))


def read_sdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(molecules: idx, label; atoms: idx, atom, element, x, y, z) of a V2000 SD file."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\$\$\$\$\r?\n?")).alias("block")).where("trim(block) <> ''")
    blocks = _numbered(whole.withColumn("_at", F.monotonically_increasing_id()), "_at").select("idx", F.split("block", r"\r?\n").alias("lines"))
    molecules = blocks.select("idx", F.trim(F.get("lines", F.lit(0))).alias("title"))
    count = F.substring(F.get("lines", F.lit(3)), 1, 3).cast("int")
    atoms = blocks.where(count > 0).select("idx", F.posexplode(F.slice("lines", F.lit(5), count)).alias("atom", "line"))
    number = lambda at: F.trim(F.substring("line", at, 10)).cast("double")
    atoms = atoms.select("idx", "atom", F.trim(F.substring("line", 32, 3)).alias("element"), number(1).alias("x"), number(11).alias("y"), number(21).alias("z"))
    return molecules.withColumn("label", item_label("title", "idx")).drop("title"), atoms


def read_conformers(spark: SparkSession, path: str) -> DataFrame:
    """(idx, conf, atom, x, y, z) from Parquet."""
    return spark.read.parquet(path).select("idx", "conf", "atom", "x", "y", "z")


def read_design_units(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of structures from Parquet, with label du_<idx> where there is none."""
    atoms = spark.read.parquet(path)
    return atoms if "label" in atoms.columns else atoms.withColumn("label", F.concat(F.lit("du_"), F.col("idx").cast("string")))


# --- Parquet -----------------------------------------------------------------------------------------------------------


def save_pairs(pairs: PairFrame, path: str) -> None:
    """The rows and, beside them, all that a reader must know, completeness, cutoff and labels included."""
    pairs.df.write.mode("overwrite").parquet(f"{path}/pairs")
    if pairs.labels is not None:
        pairs.labels.select("idx", "label").write.mode("overwrite").parquet(f"{path}/labels")
    meta = {"n": pairs.n, "comparison": pairs.comparison, "kind": pairs.kind, "complete": pairs.complete, "cutoff": pairs.cutoff, "params": pairs.params, "labelled": pairs.labels is not None}
    spark = pairs.df.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_pairs(spark: SparkSession, path: str) -> PairFrame:
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    frame = spark.read.parquet(f"{path}/labels") if meta["labelled"] else None
    return PairFrame(spark.read.parquet(f"{path}/pairs"), meta["n"], meta["comparison"], meta["kind"], meta["complete"], meta["cutoff"], meta["params"], frame)


def grow_pairs(spark: SparkSession, path: str, more: DataFrame, n: int, complete: bool = False) -> PairFrame:
    """Add rows (i, j, d) of further items to saved pairs, which now have n items.  Without all pairs of the new items the
    frame is incomplete: a pair without a row is unknown, not zero.  Labels stay with the items that had them."""
    known = load_pairs(spark, path)
    if n < known.n:
        raise ClusterEngineError(f"{known.n} items are saved; a store doesn't shrink to {n}")
    more.select("i", "j", "d").write.mode("append").parquet(f"{path}/pairs")
    meta = {"n": n, "comparison": known.comparison, "kind": known.kind, "complete": complete and known.complete, "cutoff": known.cutoff, "params": known.params, "labelled": known.labels is not None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return load_pairs(spark, path)


def write_with(pairs: PairFrame, writer: Callable[[Iterator[pa.RecordBatch]], None]) -> int:
    """Give the rows (i, j, d) to a store of one's own: writer gets the Arrow batches of one task, in every task.  A task
    that runs again calls it again.  Returns the number of rows written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            for b in batches:
                seen += b.num_rows
                yield b

        writer(counted())
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64())], names=["n"])

    return int(pairs.df.select("i", "j", "d").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0)


# --- one dense matrix ----------------------------------------------------------------------------------------------------


def save_npz(pairs: PairFrame, path: str, fill: float = 0.0) -> None:
    labels = [] if pairs.labels is None else [r["label"] for r in pairs.labels.orderBy("idx").collect()]
    np.savez(
        path,
        condensed=pairs.to_condensed(fill),
        comparison_name=np.array(pairs.comparison),
        params=np.array(json.dumps(pairs.params | {"kind": pairs.kind, "complete": pairs.complete, "cutoff": pairs.cutoff})),
        labels=np.array(labels, dtype=str),
        num_samples=np.array(pairs.n),
    )


def load_npz(spark: SparkSession, path: str) -> PairFrame:
    """Also reads files whose count is named num_items.  An incomplete matrix stays incomplete, without its zeros."""
    with np.load(path) as z:
        n = int(z["num_samples"] if "num_samples" in z else z["num_items"])
        condensed, params = z["condensed"], json.loads(str(z["params"])) if "params" in z else {}
        name = str(z["comparison_name"]) if "comparison_name" in z else "unknown"
        labels = [str(x) for x in z["labels"]] if "labels" in z else []
    kind, complete, cutoff = params.pop("kind", "distance"), params.pop("complete", True), params.pop("cutoff", None)
    i, j = np.triu_indices(n, 1)
    rows = list(zip(i.tolist(), j.tolist(), condensed.tolist(), strict=True))
    df = spark.createDataFrame(rows if complete else [r for r in rows if r[2] != 0], "i bigint, j bigint, d double")
    frame = spark.createDataFrame(list(enumerate(labels)), "idx bigint, label string") if labels else None
    return PairFrame(df, n, name, kind, complete, cutoff, params, frame)


def csv_text(matrix: np.ndarray, rows: list[str], columns: list[str]) -> str:
    """A leading blank header cell, labels without quotes, values with eight significant digits."""
    out = io.StringIO()
    out.write("," + ",".join(columns) + "\n")
    for name, line in zip(rows, matrix, strict=True):
        out.write(name + "," + ",".join(f"{v:.8g}" for v in line) + "\n")
    return out.getvalue()


def sidecar(mode: str, comparison: str, params: dict, rows: list[str], columns: list[str]) -> dict:
    return {"mode": mode, "comparison": comparison, "params": params, "n_rows": len(rows), "n_cols": len(columns), "row_labels": rows, "col_labels": columns}


def sidecar_path(path: str) -> str:
    p = PurePosixPath(path)
    return str(p.with_name(p.stem + ".json"))


def _write(path: str, data: np.ndarray, square: np.ndarray, meta: dict) -> None:
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".npy":
        with open(path, "wb") as f:
            np.lib.format.write_array(f, np.ascontiguousarray(data, dtype="<f8"), version=(1, 0))
    elif kind == ".csv":
        with open(path, "w") as f:
            f.write(csv_text(square, meta["row_labels"], meta["col_labels"]))
    elif kind == ".bin":
        np.ascontiguousarray(data, dtype="<f8").tofile(path)
    else:
        raise ValueError(f"unknown output format {kind!r}")
    with open(sidecar_path(path), "w") as f:
        json.dump(meta, f, indent=2)


def names_of(pairs: PairFrame) -> list[str]:
    if pairs.labels is None:
        return [f"item_{k}" for k in range(pairs.n)]
    return [r["label"] for r in pairs.labels.orderBy("idx").collect()]


def write_pdist(pairs: PairFrame, path: str, fill: float = 0.0) -> None:
    names = names_of(pairs)
    condensed = pairs.to_condensed(fill)
    square = np.zeros((pairs.n, pairs.n))
    upper = np.triu_indices(pairs.n, 1)
    square[upper] = condensed
    square.T[upper] = condensed
    _write(path, condensed, square, sidecar("pdist", pairs.comparison, pairs.params, names, names))


def write_cdist(cross: DataFrame, n_a: int, n_b: int, path: str, comparison: str, rows: list[str], columns: list[str], params: dict | None = None) -> None:
    """Pairs without a row (above the cutoff) are written as 0."""
    if max(n_a, n_b) > MATRIX_LIMIT:
        raise ClusterEngineError("too many items for one array")
    m = np.zeros((n_a, n_b))
    found = cross.select("i", "j", "d").toArrow()
    m[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("d").to_numpy()
    _write(path, m, m, sidecar("cdist", comparison, params or {}, rows, columns))


def open_text(path: str):
    return gzip.open(path, "rt") if path.endswith("gz") else open(path)
