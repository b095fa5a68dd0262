"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of its hashed byte trigrams (log count x inverse document frequency), projected on the leading
singular vectors of the labelled texts' matrix.  The labelled vectors are broadcast (at most 2 * DOCS rows of RANK
floats); for every document the cosines with all of them are computed exactly, block by block, and its NEIGHBOURS
nearest vote with their labels, weighted by similarity.  Votes are stretched so that the threshold that tells the
labelled texts apart best, each judged by the others, comes to lie at 0.7.

It learns from a bounded sample of labelled rows (DOCS texts of each class, by a hash of the id); every text is scored
whole, however long.  Texts that are null, empty or shorter than three bytes score 0, as does everything unless labels of
both classes are known.  A doc_id labelled more than once counts as good if half of its labels say so.  Labelled texts
that tie with the last of the nearest all vote.  Rows that repeat score alike and each gets its row; an empty table gives
an empty result; columns other than the id's and the text's are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, staged, texts_of, tidy
from .toxicity import labelled

DOCS = 2_500
BUCKETS = 2_048
RANK = 48
NEIGHBOURS = 25
#: Similarity is raised to this power to weight a vote.
SHARPNESS = 4
THRESHOLD = 0.7
BLOCK = 256


def trigram_counts(texts: list[str]) -> np.ndarray:
    """len(texts) x BUCKETS counts of hashed byte trigrams."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    who = np.repeat(np.arange(len(data)), [len(x) for x in data])
    if len(b) < 3:
        return np.zeros((len(texts), BUCKETS), dtype=np.float32)
    code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    inside = who[:-2] == who[2:]
    key = who[:-2][inside] * BUCKETS + code[inside]
    return np.bincount(key, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # BUCKETS x RANK, with the inverse document frequencies in it
    vectors: np.ndarray  # labelled texts x RANK, unit length
    labels: np.ndarray
    cut: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, v: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Weighted share of label 1 among the nearest; own: labelled rows that don't count for themselves."""
        cosine = v @ self.vectors.T
        if own is not None:
            cosine[np.arange(len(v)), own] = -2.0
        k = min(NEIGHBOURS, cosine.shape[1] - (own is not None))
        # a labelled text as similar as the k-th counts too, so ties don't hang on the order of the labelled rows
        least = np.partition(cosine, -k, axis=1)[:, -k][:, None] if k < cosine.shape[1] else np.full((len(v), 1), -1.5, dtype=cosine.dtype)
        weight = np.where(cosine >= least, np.clip(cosine, 1e-6, 1.0), 0.0).astype(np.float64) ** SHARPNESS
        return weight @ self.labels / weight.sum(axis=1)

    def stretch(self, vote: np.ndarray) -> np.ndarray:
        low = THRESHOLD * vote / max(self.cut, 1e-9)
        high = THRESHOLD + (1 - THRESHOLD) * (vote - self.cut) / max(1 - self.cut, 1e-9)
        return np.clip(np.where(vote >= self.cut, high, np.minimum(low, np.nextafter(THRESHOLD, 0))), 0.0, 1.0)

    def score(self, texts: list[str]) -> np.ndarray:
        counts = trigram_counts(texts)
        v, some = self.embed(counts), counts.any(axis=1)
        votes = np.concatenate([self.vote(v[k : k + BLOCK]) for k in range(0, len(v), BLOCK)]) if len(v) else np.zeros(0)
        return np.where(some, self.stretch(votes), 0.0)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    present = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(counts)) / (1 + present)) + 1).astype(np.float32)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = (idf[:, None] * vectors[:, ::-1][:, :RANK]).astype(np.float32)
    draft = Model(projection, np.zeros((0, RANK), np.float32), labels.astype(np.float64), 0.5)
    draft = Model(projection, draft.embed(counts).astype(np.float32), labels.astype(np.float64), 0.5)
    rows = np.arange(len(labels))
    votes = np.concatenate([draft.vote(draft.vectors[k : k + BLOCK], rows[k : k + BLOCK]) for k in range(0, len(labels), BLOCK)])
    cuts = np.unique(np.round(np.quantile(votes, np.linspace(0, 1, 201)), 6))
    good = [(votes[labels == 1] >= c).mean() + (votes[labels == 0] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(good) >= max(good) - 1e-9)
    return Model(projection, draft.vectors, draft.labels, float(np.clip(cuts[best].mean(), 1e-3, 1 - 1e-3)))


def train(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", docs: int = DOCS) -> Model | None:
    chosen = labelled(labels, "quality", 4, 2, docs, id_col).select(F.col(id_col).alias("_id"), "_label")
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_chunks(batch.column(2), rows=500):
                counts = trigram_counts(texts_of(batch.column(2), start, stop)).astype(np.uint32)
                raw = pa.array([x.tobytes() for x in counts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, stop - start) for k in (0, 1)] + [raw], names=["_id", "y", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    found = staged(texts.select("_id", "_label", "_text").mapInArrow(tidy(vectors), f"_id {kind}, y int, x binary"), "labelled").orderBy("_id", "x").toArrow()
    y = np.array(found.column("y").to_pylist())
    if len(set(y.tolist())) < 2:
        return None
    counts = np.stack([np.frombuffer(x, np.uint32) for x in found.column("x").to_pylist()]).astype(np.float32)
    return fit(counts, y)


def score(df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id, held_out, score, predicted."""
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, text, id_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_chunks(batch.column(1), rows=500):
                texts = texts_of(batch.column(1), start, stop)
                s = model.value.score(texts) if model.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(s, pa.float64())], names=["_id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(tidy(scored), f"_id {kind}, score double")
    held = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit(""))) % 4 == 2
    return out.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
