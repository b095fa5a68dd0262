"""Structures compared after optimal superposition (Kabsch), or by their inner distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.selection import select


def structures(atoms: DataFrame, selection: str = "") -> DataFrame:
    """(idx, coords): x, y, z of the selected atoms of each structure, flat, in order of atom."""
    chosen = select(atoms, selection) if selection else atoms
    rows = chosen.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("a"))
    return rows.select("idx", F.flatten(F.transform("a", lambda r: F.array(r["x"], r["y"], r["z"]))).alias("coords"))


def sides(reference: DataFrame, fit: DataFrame, predicate: str = "", ref_predicate: str | None = None, fit_predicate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """structures() of both sides; a side's own predicate goes before the general one."""
    return structures(reference, predicate if ref_predicate is None else ref_predicate), structures(fit, predicate if fit_predicate is None else fit_predicate)


def kabsch(a: np.ndarray, b: np.ndarray) -> float:
    """RMSD of two n x 3 arrays after the best rotation and translation of b; NaN if they differ in size."""
    if a.shape != b.shape or not len(a):
        return float("nan")
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def distance_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square difference of the two sets of inner distances."""
    if a.shape != b.shape or len(a) < 2:
        return float("nan")
    i, j = np.triu_indices(len(a), 1)
    d = [np.linalg.norm(x[i] - x[j], axis=1) for x in (a, b)]
    return float(np.sqrt(((d[0] - d[1]) ** 2).mean()))


def rmsd_metric(method: str = "kabsch"):
    """A metric between items with `coords`, as an Arrow-batched function."""
    compare = {"kabsch": kabsch, "ddm": distance_difference}[method]

    @pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compare(np.asarray(x, float).reshape(-1, 3), np.asarray(y, float).reshape(-1, 3)) for x, y in zip(a, b, strict=True)])

    def metric(a: str, b: str) -> Column:
        return distance(F.col(f"{a}.coords"), F.col(f"{b}.coords"))

    return metric
