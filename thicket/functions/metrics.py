"""Distances and similarities of two items as column expressions; `a` and `b` name the sides of a pair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAN

Metric = Callable[[str, str], Column]
#: Metrics of binary fingerprints; those that only come as distances.
FINGERPRINT = ("tanimoto", "jaccard", "dice", "manhattan")
DISTANCE_ONLY = ("jaccard", "dice", "manhattan")
VECTOR = ("cosine", "euclidean", "manhattan")


def _common(a: str, b: str, n_words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.words")[k].bitwiseAND(F.col(f"{b}.words")[k])) for k in range(n_words)))


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under == 0, F.lit(NAN)).otherwise(over / under.cast("double"))


def fingerprint(metric: str = "tanimoto", similarity: bool = False, n_words: int = 1) -> Metric:
    """Column of the metric between packed fingerprints with cached popcounts."""
    metric = metric.lower()
    if metric in ("cosine", "euclidean"):
        raise ValueError(f"{metric} is not offered for fingerprints; use vectors")
    if metric not in FINGERPRINT:
        raise ValueError(f"unknown fingerprint metric {metric!r}")
    if similarity and metric in DISTANCE_ONLY:
        raise ValueError(f"{metric} is a distance only")

    def expression(a: str, b: str) -> Column:
        both, p, q = _common(a, b, n_words), F.col(f"{a}.popcount"), F.col(f"{b}.popcount")
        if metric in ("tanimoto", "jaccard"):
            s = _ratio(both, p + q - both)
            return s if similarity else 1.0 - s
        if metric == "dice":
            return 1.0 - _ratio(2 * both, p + q)
        return (p + q - 2 * both).cast("double")

    expression.packed = (metric, similarity, n_words)  # for operators.packed
    return expression


def vector(metric: str, size: int, column: str = "vector", similarity: bool = False) -> Metric:
    """Column of the metric between arrays of doubles, unrolled so that it stays in generated code."""
    metric = metric.lower()
    if metric not in VECTOR:
        raise ValueError(f"unknown vector metric {metric!r}")
    if similarity and metric != "cosine":
        raise ValueError(f"{metric} is a distance only")

    def total(term: Callable[[Column, Column], Column], a: str, b: str) -> Column:
        x, y = F.col(f"{a}.{column}"), F.col(f"{b}.{column}")
        return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda s, t: s + t)

    def expression(a: str, b: str) -> Column:
        if metric == "euclidean":
            return F.sqrt(total(lambda x, y: (x - y) * (x - y), a, b))
        if metric == "manhattan":
            return total(lambda x, y: F.abs(x - y), a, b)
        dot, n, m = total(lambda x, y: x * y, a, b), total(lambda x, y: x * x, a, a), total(lambda x, y: x * x, b, b)
        c = F.when(n * m == 0, F.lit(NAN)).otherwise(dot / F.sqrt(n * m))
        return c if similarity else 1.0 - c

    if metric != "manhattan":
        expression.dense = (column, metric, size, similarity)  # for operators.dense
    return expression


def numeric(column: str = "x") -> Metric:
    return lambda a, b: F.abs(F.col(f"{a}.{column}") - F.col(f"{b}.{column}"))


def mutual_reachability(core_i: Column, core_j: Column, d: Column, alpha: float = 1.0) -> Column:
    return F.greatest(core_i, core_j, d / F.lit(float(alpha)))


def shape_score(kind: str, score: Column, similarity: bool = False) -> Column:
    """Distance of a 3-D overlay score: combo_norm 1 - s/2, combo 2 - s, shape and color 1 - s."""
    tops = {"combo_norm": 1.0, "combo": 2.0, "shape": 1.0, "color": 1.0}
    if kind not in tops:
        raise ValueError(f"unknown score {kind!r}")
    value = score / 2 if kind == "combo_norm" else score
    return value if similarity else tops[kind] - value


def superposition_score(method: str, score: Column, similarity: bool = False) -> Column:
    """RMSD methods give distances whatever is asked for; sse: 1 - Tanimoto; site: 4 - patch score.  A negative score
    marks a failed superposition and raises."""
    ok = F.when(score < 0, F.raise_error(F.lit(f"{method}: superposition failed"))).otherwise(score)
    if method in ("global_carbon_alpha", "global", "ddm", "weighted"):
        return ok
    if method not in ("sse", "site_hopper"):
        raise ValueError(f"unknown superposition method {method!r}")
    return ok if similarity else (1.0 if method == "sse" else 4.0) - ok
