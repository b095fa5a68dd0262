"""Passages that repeat across documents, found with a sparse suffix array.

Suffixes are retained only where the content selects them: a window of MIN_WORDS words keeps the suffix that starts at
its smallest run of HEAD words (by hash), so equal windows keep equal suffixes wherever they stand.  The retained
suffixes are sorted by content, block of HEAD words after block, over the whole cluster, and each is compared with its
neighbours; those that share no block with one go.  The others are extended to the left and right: every place where a
passage of MIN_WORDS words around a shared block can begin becomes a suffix of its own, these are sorted by their
MIN_WORDS words, and neighbours of different texts that agree mark them as repeated.  What repeats is merged into maximal
spans.

Both sorts are range sorts with the text as last key, so a block or passage that a third of all texts share is dealt to as
many tasks as its share needs, and a task looks at one suffix and its neighbour at a time.  Where a run of equal passages
may go on in the next task's range, both tasks tell its ends, and these few rows are settled in a small aggregate.

The result is exact: the spans cover all words, and only those, that lie in a run of at least MIN_WORDS words that also
occurs in another document.  (Texts and passages are equal if 128 bits of hash are.)  A text that several documents share
is one text, and repeats as a whole if it is long enough.  Words are runs of non-space, compared as they are; null counts
as empty; texts of fewer than MIN_WORDS words have no spans; rows that agree in doc_id and text are one document, and a
null doc_id is an id.  Long texts are read whole; an empty table gives an empty result; columns other than the id's and
the text's are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, few_rows, staged, texts_of, tidy
from .wordhash import Batch, polynomial, rolled

MIN_WORDS = 50
HEAD = 16
#: Blocks of HEAD words that suffixes are sorted by.
BLOCKS = 3


def window_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by doubling."""
    size, out = 1, g
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(g) - width + 1], out[width - size :][: len(g) - width + 1])


def heads(h: np.ndarray, length: int = MIN_WORDS, head: int = HEAD) -> np.ndarray:
    """The retained head of every window of `length` words."""
    return window_minima(rolled(h, head), length - head + 1)


def _retained(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(block0, ..., t1, t2, n) of the retained suffixes, the first of each head in a text, and the text's number of words;
    blocks beyond the text are 0."""
    for batch in batches:
        for start, stop in byte_chunks(batch.column(2)):
            words = Batch([t.encode("utf-8", "surrogatepass") for t in texts_of(batch.column(2), start, stop)])
            out = []
            for k in range(stop - start):
                if words.counts[k] >= length:
                    h = words.hash[words.bounds[k] : words.bounds[k + 1]]
                    found = np.unique(heads(h, length))
                    block = rolled(h, HEAD)
                    values, first = np.unique(block, return_index=True)
                    at = first[np.searchsorted(values, found)]
                    padded = np.concatenate((block, np.zeros(HEAD * BLOCKS, dtype=np.uint64)))
                    own = [np.full(len(at), x, dtype=np.int64) for x in (batch.column(0)[start + k].as_py(), batch.column(1)[start + k].as_py(), len(h))]
                    out.append(np.stack([*(padded[at + HEAD * b].view(np.int64) for b in range(BLOCKS)), *own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=[*(f"block{b}" for b in range(BLOCKS)), "t1", "t2", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes (block0, t1, t2) in order: (t1, t2, head) of those that share their first block with a neighbour of
    another text.  The first and last of a task pass unseen, as their neighbours are elsewhere; extension settles them."""
    held = np.zeros((3, 0), dtype=np.int64)
    first, shared_last = True, False
    for batch in batches:
        rows = np.concatenate((held, np.stack([batch.column(k).to_numpy() for k in range(3)])), axis=1)
        if not rows.shape[1]:
            continue
        # copies of a text bring the same suffixes; one of each is left
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, new]
        same = rows[0, 1:] == rows[0, :-1]
        shared = np.zeros(rows.shape[1], dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= first or shared_last
        first = False
        held, shared_last = rows[:, -1:], bool(shared[-1])
        out = rows[:, :-1][:, shared[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[2]), pa.array(out[0])], names=["t1", "t2", "head"])
    if held.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2]), pa.array(held[0])], names=["t1", "t2", "head"])


def _extended(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(w1, w2, t1, t2, at) of every passage of `length` words around a shared head."""
    for batch in batches:
        for k in range(batch.num_rows):
            h = Batch([(batch.column(3)[k].as_py() or "").encode("utf-8", "surrogatepass")]).hash
            if len(h) < length:
                continue
            found = np.array(batch.column(2)[k].as_py(), dtype=np.int64).view(np.uint64)
            at = np.flatnonzero(np.isin(heads(h, length), found))
            keys = [x[at].view(np.int64) for x in (rolled(h, length), polynomial(h, length))]
            own = [np.full(len(at), batch.column(c)[k].as_py(), dtype=np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (*keys, *own, at.astype(np.int32)))], names=["w1", "w2", "t1", "t2", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of passages (w1, w2, t1, t2, at) in order: those that another text has, too.  Equal passages are neighbours, and
    differ in their texts if the first and the last do.  Rows with edge are not settled: the run of equal passages at
    either end of the task may go on in another, so its first and last text are told (with -1 as at), and if these are
    the same, its rows."""

    def out(rows: np.ndarray, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows[:4]), pa.array(rows[4].astype(np.int32)), pa.array(np.full(rows.shape[1], edge))], names=["w1", "w2", "t1", "t2", "at", "edge"])

    def ends(run: np.ndarray) -> np.ndarray:
        found = run[:, [0, -1]].copy()
        found[4] = -1
        return found

    held = np.zeros((5, 0), dtype=np.int64)  # what is left of the last run: all of it, or its last row if it is known
    front = held  # its first row
    known, opening = False, True  # whether the held run has several texts; whether it is the task's first
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])), axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        stops = np.append(starts[1:], rows.shape[1])
        differ = (rows[2:4, starts] != rows[2:4, stops - 1]).any(axis=0)
        if held.shape[1]:
            differ[0] |= known
        last = int(starts[-1])
        if last or not held.shape[1]:
            front = rows[:, last : last + 1]
        if opening and len(starts) > 1:
            yield out(ends(rows[:, : stops[0]]), True)
            if not differ[0]:
                yield out(rows[:, : stops[0]], True)
            opening = False
        if len(starts) > 1:
            done = rows[:, : last][:, np.repeat(differ[:-1], np.diff(starts))]
            # a held row of a known run was given out before
            yield out(done[:, 1:] if held.shape[1] and known and differ[0] else done, False)
        run = rows[:, last:]
        if differ[-1]:
            again = len(starts) == 1 and held.shape[1] and known
            yield out(run[:, 1:] if again else run, False)
            if opening and not again:
                yield out(ends(run), True)
            held, known = run[:, -1:], True
        else:
            held, known = run, False
    if held.shape[1]:
        yield out(ends(np.concatenate((front, held), axis=1)), True)
        if not known:
            yield out(held, True)


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans that the windows with these first words cover; spans that only touch stay apart."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) >= length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, breaks)]


def spans(df: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = MIN_WORDS) -> DataFrame:
    """(id_col, spans array<struct<first, past>>, in words) of every document with a repeated passage."""
    own = ["t1", "t2"]
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"t1": F.xxhash64("_text"), "t2": F.xxhash64(F.lit(MIN_WORDS), "_text", F.length("_text"))})
    blocks = [f"block{b}" for b in range(BLOCKS)]
    retained = staged(rows.select(*own, "_text").mapInArrow(tidy(lambda x: _retained(x, length)), ", ".join(f"{c} long" for c in (*blocks, *own, "n"))), "suffixes")
    shared = retained.orderBy(*blocks, *own).select("block0", *own).mapInArrow(tidy(_neighbours), "t1 long, t2 long, head long")
    wanted = staged(shared.groupBy(*own).agg(F.collect_set("head").alias("heads")), "shared")

    # each task keeps one copy of a text before the shuffle, so a text that many rows share stays small
    texts = rows.select(*own, "_text").dropDuplicates(own).join(wanted, own).select(*own, "heads", "_text")
    with few_rows(df.sparkSession, 512):
        passages = staged(texts.mapInArrow(tidy(lambda x: _extended(x, length)), "w1 long, w2 long, t1 long, t2 long, at int"), "passages")
    found = passages.orderBy("w1", "w2", *own, "at").mapInArrow(tidy(_repeated), "w1 long, w2 long, t1 long, t2 long, at int, edge boolean")
    found = staged(found, "repeated")
    edges = found.where("edge")
    text_of = F.struct(*own)
    between = edges.groupBy("w1", "w2").agg(F.min(text_of).alias("a"), F.max(text_of).alias("b")).where("a <> b").select("w1", "w2")
    settled = found.where("not edge").select(*own, "at").union(edges.where("at >= 0").join(between, ["w1", "w2"], "left_semi").select(*own, "at"))
    starts = settled.groupBy(*own).agg(F.collect_set("at").alias("starts"))

    someone = F.struct(F.col("_id").isNull(), "_id")
    copied = rows.groupBy(*own).agg(F.min(someone).alias("a"), F.max(someone).alias("b")).where("a <> b").select(*own)
    whole = retained.groupBy(*own).agg(F.first("n").cast("int").alias("n")).join(copied, own, "left_semi")

    def to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for batch in batches:
            out = []
            for at, n in zip(batch.column(2), batch.column(3), strict=True):
                pairs = [(0, n.as_py())] if n.as_py() is not None else merged(np.array(at.as_py()), length)
                out.append([{"first": a, "past": b} for a, b in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["t1", "t2", "spans"])

    by_text = starts.join(whole, own, "full").select(*own, "starts", "n").mapInArrow(tidy(to_spans), "t1 long, t2 long, spans array<struct<first: int, past: int>>")
    owners = rows.select("_id", *own).distinct()
    return owners.join(staged(by_text, "spans"), own).select(F.col("_id").alias(id_col), "spans")


def digest(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with a repeated passage: its id, n_spans, repeated_words, spans."""
    out = spans(df, text, id_col)
    covered = F.aggregate("spans", F.lit(0), lambda a, s: a + s["past"] - s["first"]).cast("long")
    return out.select(id_col, F.size("spans").cast("long").alias("n_spans"), covered.alias("repeated_words"), "spans")
