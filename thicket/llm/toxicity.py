"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's own trainer, one on toxic and one on ordinary text.  A text is
cut into windows, each window is compressed with either dictionary, and the difference of the two lengths is that
window's evidence: toxic passages come out shorter with the toxic dictionary.  Windows are words with the space on either
side (runs without spaces are cut every WINDOW bytes): in longer windows, the chance matches of ordinary words drown the
few bytes that one toxic word saves.

Most of a toxic text is as ordinary as any other, and a trainer that sees all of it fills its dictionary with common
words.  So the toxic dictionary is trained on those windows of toxic texts that stand out (LEAST_Z standard errors more
frequent than in ordinary texts), each as often as texts have it, and the ordinary one on those windows of ordinary texts
that the toxic dictionary makes shorter, so that ordinary relatives of toxic words are a match for it.  Both are used as
content that ends with the same PREFIX, which also goes before every window: without a sure match, zstd stores short
windows as they are, and small savings would not show.

Thresholds are calibrated on other labelled texts than the dictionaries': every (difference, length) has its log-odds of
being from a toxic text; a text's features are the mean and the shares of its windows beyond several log-odds, weighed by
a logistic regression whose score is moved so that 0.5 is the cut (a wrongly rejected text counts as COST missed ones).

It learns from bounded samples of labelled rows (DOCS texts of each class, by a hash of the id), which are joined to
their texts once; every text is scored whole, however long.  Null counts as empty; a text without windows has no evidence
and scores below 0.5; with labels of one class only, or none, every score is 0.  A doc_id labelled more than once counts
as toxic if half of its labels say so.  Rows that repeat score alike and each gets its row; a score of exactly 0.5 is
toxic; an empty table gives an empty result; columns other than the id's and the text's are passed on unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, staged, texts_of, tidy

#: Labelled texts of each class; half of them for the dictionaries, half for the thresholds.
DOCS = 4_000
#: Different windows that either dictionary is trained on, and bytes that it may hold.
TOXIC_WINDOWS, ORDINARY_WINDOWS = 4_000, 30_000
TOXIC_BYTES, ORDINARY_BYTES = 4_000, 24_000
LEAST_Z = 4.0
#: The trainer's segments and the strings that it counts, in bytes.
SEGMENT, STRING = 16, 6
#: Largest log odds of a window that the ordinary dictionary is trained on.
TAME = 0.5
WINDOW = 48
COST = 3.0
PREFIX = b"<<=~=~=|:|:|:[#]{1}{2}{3}{4}{5}^^\x01\x02\x03\x04\x05\x06\x07>>"
EDGES = b".,;:!?\"'()[]*#%&$|-_"
LOWEST, HIGHEST, LONGEST = -6, 15, 31
CELLS = (HIGHEST - LOWEST + 1) * (LONGEST + 1)
BEYOND = (0.7, 1.5, 2.0, 2.5, 3.0)
REMEMBERED = 300_000


def windows(text: str) -> list[bytes]:
    out = []
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        if word := word.strip(EDGES):
            out += [b" " + word[k : k + WINDOW] + b" " for k in range(0, len(word), WINDOW)] if len(word) > WINDOW else [b" " + word + b" "]
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; of samples too few for the trainer, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STRING, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def spread(counts: dict[bytes, int]) -> list[bytes]:
    """Every window as often as it counts, mixed as in texts: the trainer takes one segment from each stretch."""
    return [w for _, w in sorted((zlib.crc32(b"%d " % k + w), w) for w, n in counts.items() for k in range(n))]


def compressor(content: bytes):
    """Length of a window compressed with a dictionary of this content."""
    d = zstandard.ZstdCompressionDict(content + PREFIX, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    d.precompute_compress(compression_params=p)
    compress = zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress
    return lambda window: len(compress(PREFIX + window))


class Distance:
    """The cell (difference, length) of a window; frequent windows are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        self.known: dict[bytes, int] = {}

    def difference(self, window: bytes) -> int:
        return self.ordinary(window) - self.toxic(window)

    def cell(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            d = min(HIGHEST, max(LOWEST, self.difference(window))) - LOWEST
            found = self.known[window] = d * (LONGEST + 1) + min(LONGEST, len(window))
        return found

    def cells(self, text: str) -> np.ndarray:
        cell = self.cell
        return np.array([cell(w) for w in windows(text)], dtype=np.int64)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    odds: np.ndarray
    weights: np.ndarray
    shift: float

    def score(self, distance: Distance, texts: list[str]) -> np.ndarray:
        x = np.array([features(self.odds, distance.cells(t)) for t in texts]).reshape(len(texts), 2 + len(BEYOND))
        return sigmoid(x @ self.weights + self.shift)


def features(odds: np.ndarray, cells: np.ndarray) -> list[float]:
    """Mean log-odds, mean of the positive ones, shares beyond the BEYOND."""
    if not len(cells):
        return [0.0] * (2 + len(BEYOND))
    x = odds[cells]
    return [x.mean(), np.maximum(x, 0).mean(), *((x >= t).mean() for t in BEYOND)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, classes weighted alike; weights for unscaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(a.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-9)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (weight * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def labelled(labels: DataFrame, label: str, modulus: int, held: int, docs: int, id_col: str = "doc_id") -> DataFrame:
    """At most `docs` ids of each class, (id, label 0/1), without the held-out ones and rows without a label."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col(id_col).cast("string")) % modulus != held)
    one = usable.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    picks = [one.where(F.col("_label") == k).orderBy(F.xxhash64(id_col), id_col).limit(docs) for k in (0, 1)]
    return picks[0].union(picks[1])


def _windows_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, toxic) once for each text that has the window."""
    for batch in batches:
        for start, stop in byte_chunks(batch.column(1)):
            found = [set(windows(t)) for t in texts_of(batch.column(1), start, stop)]
            toxic = np.repeat(np.array(batch.column(0).slice(start, stop - start).to_pylist(), dtype=np.int32), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.binary()), pa.array(toxic)], names=["w", "toxic"])


def dictionaries(counts: DataFrame, toxic: int, ordinary: int) -> tuple[bytes, bytes]:
    """Both dictionaries, from (w, a, b): in how many toxic and ordinary texts a window is."""
    a, b = F.col("a"), F.col("b")
    p = (a + b + 1) / (toxic + ordinary + 2)
    z = (a / toxic - b / ordinary) / F.sqrt(p * (1 - p) * (1 / toxic + 1 / ordinary))
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (ordinary + 1))
    bad = counts.where((a >= 2) & (z >= LEAST_Z)).orderBy(F.desc(z), "w").limit(TOXIC_WINDOWS).collect()
    tame = counts.where((b >= 1) & (odds < TAME)).orderBy(F.desc("b"), "w").limit(ORDINARY_WINDOWS).collect()
    first = dictionary(spread({bytes(r["w"]): r["a"] for r in bad}), TOXIC_BYTES)
    draft = Distance(first, b"")
    second = dictionary(spread({bytes(r["w"]): r["b"] for r in tame if draft.difference(bytes(r["w"])) > 0}), ORDINARY_BYTES)
    return first, second


def train(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", docs: int = DOCS) -> Model | None:
    """None if there aren't labelled texts of both classes in both halves."""
    chosen = labelled(labels, "toxic", 5, 0, docs, id_col).select(F.col(id_col).alias("_id"), "_label")
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    texts = staged(texts.select("_label", "_text", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).alias("_half")), "labelled")
    made, judged = (texts.where(F.col("_half") == k).select("_label", "_text") for k in (0, 1))
    sizes = {r["_label"]: r["count"] for r in made.groupBy("_label").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 10:
        return None
    counts = made.mapInArrow(tidy(_windows_of_texts), "w binary, toxic int").groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    toxic, ordinary = dictionaries(staged(counts, "windows"), sizes[1], sizes[0])

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary)
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(1)):
                h = np.bincount(distance.cells(t), minlength=CELLS).astype(np.float32)
                rows.append((h / max(1.0, float(h.sum()))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["y", "h"])

    found = judged.mapInArrow(tidy(histograms), "y int, h binary").orderBy("y", "h").toArrow()
    y = np.array(found.column("y").to_pylist())
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return None
    h = np.stack([np.frombuffer(x, np.float32) for x in found.column("h").to_pylist()]).astype(np.float64)
    odds = np.log((h[y == 1].mean(axis=0) + 2e-5) / (h[y == 0].mean(axis=0) + 2e-5))
    x = np.column_stack([h @ odds, h @ np.maximum(odds, 0), *(h @ (odds >= t) for t in BEYOND)])
    w, shift = fit_logistic(x, y)
    p = sigmoid(x @ w + shift)
    cuts = np.unique(np.quantile(p, np.linspace(0, 1, 801)))
    gain = [(p[y == 1] >= c).mean() - COST * (p[y == 0] >= c).mean() for c in cuts]
    at = float(np.clip(np.mean(cuts[np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)]), 1e-6, 1 - 1e-6))
    none = sigmoid(np.array([shift]))[0]
    at = max(at, float(none) + 1e-9)
    return Model(toxic, ordinary, odds, w, float(shift - np.log(at / (1 - at))))


def _scores(model: Model | None, distance: Distance | None, column: pa.Array) -> np.ndarray:
    out = [model.score(distance, texts_of(column, a, b)) if model else np.zeros(b - a) for a, b in byte_chunks(column)]
    return np.concatenate(out) if out else np.zeros(0)


def score(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id, held_out, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, labels, text, id_col))
    kind = df.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        distance = Distance(model.toxic, model.ordinary) if model else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, distance, batch.column(1)), pa.float64())], names=["_id", "score"])

    out = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(tidy(scored), f"_id {kind}, score double")
    held = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))) % 5 == 0
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose score is below 0.5, with df's columns."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, labels, text, id_col))

    def mild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        distance = Distance(model.toxic, model.ordinary) if model else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, distance, batch.column(batch.schema.names.index(text))) < 0.5, pa.bool_()))

    return df.mapInArrow(tidy(mild), df.schema)
