"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010) with word trigrams.

Two models of the same form share one vocabulary, the distinct words of all texts and an end mark, so no word is unknown
to either: the target model counts the texts labelled good, the background model counts every text.  Each interpolates
trigrams, bigrams, unigrams and the uniform distribution over the vocabulary.  Word by word, the target's loss minus the
background's is averaged over the whole text (begun by two marks, closed by the end mark, which is a token too): the
lower, the more the text is like the target.  A text's own counts are taken out of both models before it is scored, so a
labelled text has no advantage of being labelled.

Texts are dealt into chunks of CHUNK_BYTES.  A chunk asks for the counts of its distinct n-grams, each once whatever its
texts repeat, in pieces by ranges of the n-grams' hashes; every range adds up what all chunks found and answers each of
them.  The counts stay distributed, nothing but five sums goes to the driver, a frequent n-gram is one entry a chunk, and
the ranges grow in number with the texts, so that each holds about RANGE_BYTES of text.

Words are maximal runs without white space, case kept.  N-grams stand for themselves by a hash that grows with the bytes
of all texts (SPARE bits more than their number has, 62 at most), so the odds that one falls together with another are
about 1e-6 at every size.  Null counts as empty; a text without words has no tokens and all its scores are 0.  Rows that
repeat count each time, and each is the other's evidence.  Equal scores are left as ties.  Without labelled texts the
target is uniform; an empty table gives an empty result; a text longer than a chunk is a chunk of its own; columns other
than the id's and the text's are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import wordhash
from .common import byte_chunks, few_rows, give_back, staged, texts_of, tidy

CHUNK_BYTES = 6_000_000
RANGE_BYTES = 8_000_000
LEAST_RANGES = 64
SPARE = 18
#: Ids labelled good that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
LEVEL = 6
#: Weight of the lower order, in tokens: P(c | h) = (count(h, c) + K * P(c | shorter h)) / (count(h) + K).
K = (4.0, 16.0, 64.0)  # for trigrams, bigrams, unigrams
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C1E2F9A7)
SUMS = ("vocabulary", "tokens", "target_tokens", "texts", "target_texts")
LONGS = ", ".join(f"{c} long" for c in SUMS)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return wordhash.mix(a * np.uint64(0xD1342543DE82EF95) + b)


def marked(df: DataFrame, good: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _good, _text) of every row of df."""
    ids = good.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_good", F.lit(True))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return rows.join(ids, "_id", "left").select("_id", F.coalesce("_good", F.lit(False)).alias("_good"), "_text")


def key_bits(size: int) -> int:
    """Bits of an n-gram's hash, for so many bytes of text."""
    return min(62, max(32, int(size).bit_length() + SPARE))


def _tagged(h: np.ndarray, order: int, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits) << np.uint64(64 - bits) | np.uint64(order)


def end_key(bits: int) -> np.uint64:
    return _tagged(wordhash.mix(np.array([END])), 1, bits)[0]


def ngrams(texts: list[str], bits: int = 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the unigram, bigram and trigram that end at each token (3 x tokens), the token's text, and whether it is
    the first of its text."""
    batch = wordhash.Batch([t.encode("utf-8", "surrogatepass") for t in texts])
    some = batch.counts > 0
    sizes = batch.counts + some
    stops = np.cumsum(sizes)
    who = np.repeat(np.arange(len(sizes)), sizes)
    word, first = np.ones(len(who), dtype=bool), np.zeros(len(who), dtype=bool)
    word[stops[some] - 1] = False
    first[(stops - sizes)[some]] = True
    token = np.full(len(who), END, dtype=np.uint64)
    token[word] = batch.hash
    before = np.concatenate(([BEGIN], token))[:-1]
    before[first] = BEGIN
    two = _pair(before, token)
    head = np.concatenate(([BEGIN], two))[:-1]
    head[first] = BEGIN
    return np.stack([_tagged(wordhash.mix(token), 1, bits), _tagged(two, 2, bits), _tagged(_pair(head, token), 3, bits)]), who, first


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the order that sorts the keys, and where each distinct key starts in it."""
    order = np.argsort(keys)
    found = keys[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), dtype=bool), found[1:] != found[:-1])))
    return found[starts], order, starts


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a key; grows with the key, so sorted keys are sorted by range."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds all of them (the length tells which), compressed."""
    return zstandard.compress(x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes(), 3)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.frombuffer(raw, dtype=f"u{len(raw) // n}").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, byte by byte from the lowest: the upper bytes are nearly all 0."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_keys(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def places(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the distinct key of every key."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return out


def _chunked(limit: int):
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, bytes, rows): one row per chunk, of the rows (id, good, text) as a compressed Arrow stream."""
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop in byte_chunks(batch.column(2), limit, 1 << 30):
                part = batch.slice(start, stop - start)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part.nbytes]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bytes", "rows"])
                chunk += 1

    return chunked


def _rows(cell: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(cell.as_buffer()).read_next_batch()


def _ask(ranges: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _rows(cell)
                keys, who, _ = ngrams(texts_of(rows.column(2)), bits)
                good = np.array(rows.column(1).to_pylist(), dtype=np.int64)[who]
                for k in range(len(keys) if len(who) else 0):
                    found, order, starts = distinct(keys[k])
                    n, m = np.diff(np.append(starts, len(order))), np.add.reduceat(good[order], starts)
                    edges = np.searchsorted(range_of(found, ranges), np.arange(ranges + 1))
                    at = [r for r in range(ranges) if edges[r] < edges[r + 1]]
                    cut = [slice(edges[r], edges[r + 1]) for r in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk] * len(at), pa.int64()),
                            pa.array([k] * len(at), pa.int32()),
                            pa.array(at, pa.int32()),
                            pa.array([packed_keys(found[c]) for c in cut], pa.binary()),
                            pa.array([packed(n[c]) for c in cut], pa.binary()),
                            pa.array([packed(m[c]) for c in cut], pa.binary()),
                        ],
                        names=["chunk", "order", "range", "keys", "n", "m"],
                    )

    return ask


def _answer(asked: pa.Table, end: np.uint64) -> pa.Table:
    """The counts of one range over all chunks, for each chunk in the order in which it asked; the range's sums stand in
    the first row."""
    keys = [unpacked_keys(x) for x in asked["keys"].to_pylist()]
    sizes = list(map(len, keys))
    found, order, starts = distinct(np.concatenate(keys))
    place, cuts = places(order, starts), np.cumsum(sizes)[:-1]
    single, ends = found & np.uint64(3) == 1, found == end
    totals, back = [], []
    for c in ("n", "m"):
        given = np.concatenate([unpacked(x, size) for x, size in zip(asked[c].to_pylist(), sizes, strict=True)])
        totals.append(np.add.reduceat(given[order], starts))
        back.append(pa.array([packed(x) for x in np.split(totals[-1][place], cuts)], pa.binary()))
    sums = [int(single.sum()), *[int(t[single].sum()) for t in totals], *[int(t[ends].sum()) for t in totals]]
    rest = [0] * (len(sizes) - 1)
    return pa.table(
        [asked["chunk"], asked["order"], asked["range"], *back, pa.array(sizes, pa.int64()), *[pa.array([x, *rest], pa.int64()) for x in sums]],
        names=["chunk", "order", "range", "n", "m", "size", *SUMS],
    )


def in_own_text(place: np.ndarray, who: np.ndarray) -> np.ndarray:
    """How often the n-gram of every token (by its number) occurs in the token's own text."""
    code = who * (int(place.max(initial=0)) + 1) + place
    _, order, starts = distinct(code)
    n = np.diff(np.append(starts, len(order)))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(n, n)
    return out


def token_losses(counts: np.ndarray, first: np.ndarray, texts: np.ndarray, tokens: np.ndarray, vocabulary: int) -> np.ndarray:
    """Loss in nats of every token, from the counts of its unigram, bigram and trigram (3 x tokens), and of the texts and
    tokens of the model.  Each token but the end mark is followed by another, so the count of a context is its count as
    an n-gram."""
    one, two, three = counts.astype(np.float64)
    before = np.concatenate(([0.0], one))[:-1]
    head = np.concatenate(([0.0], two))[:-1]
    before[first] = head[first] = texts[first]
    p = (one + K[2] / vocabulary) / (tokens + K[2])
    p = (two + K[1] * p) / (before + K[1])
    p = (three + K[0] * p) / (head + K[0])
    return -np.log(p)


def _scored(sums: dict[str, int], kind: pa.DataType, bits: int):
    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(chunk["rows"][0])
        texts = texts_of(rows.column(2))
        keys, who, first = ngrams(texts, bits)
        tokens = np.bincount(who, minlength=len(texts))
        good = np.array(rows.column(1).to_pylist(), dtype=np.int64)
        counts = {c: np.zeros(keys.shape, dtype=np.int64) for c in ("m", "n")}
        for k in range(len(keys) if len(who) else 0):
            _, order, starts = distinct(keys[k])
            place = places(order, starts)
            own = in_own_text(place, who)
            part = answers.filter(pc.equal(answers["order"], k)).sort_by("range")
            for c, mine in (("n", own), ("m", own * good[who])):
                counts[c][k] = np.concatenate([unpacked(x, n) for x, n in zip(part[c].to_pylist(), part["size"].to_pylist(), strict=True)])[place] - mine
        del keys
        mean = []
        for c, t, m, own in (("m", "target_texts", "target_tokens", good), ("n", "texts", "tokens", np.ones(len(texts), dtype=np.int64))):
            loss = token_losses(counts[c], first, (sums[t] - own)[who], (sums[m] - own * tokens)[who], max(1, sums["vocabulary"]))
            mean.append(np.bincount(who, weights=loss, minlength=len(texts)) / np.maximum(tokens, 1))
        out = [rows.column(0).cast(kind), pa.array(tokens, pa.int64()), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])]
        del counts, loss, rows, texts
        give_back()
        return pa.table(out, names=["_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return scored


def score(df: DataFrame, good: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id, n_tokens, target_loss, background_loss, difference (mean nats for each token)."""
    spark, field = df.sparkSession, df.schema[id_col]
    kind = field.dataType.simpleString()
    chunks = staged(marked(df, good, text, id_col).mapInArrow(tidy(_chunked(CHUNK_BYTES)), "chunk long, bytes long, rows binary"), "chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    ranges, bits = max(LEAST_RANGES, -(-size // RANGE_BYTES)), key_bits(size)
    end = end_key(bits)
    with few_rows(spark, 1):
        asked = chunks.select("chunk", "rows").mapInArrow(tidy(_ask(ranges, bits)), "chunk long, order int, range int, keys binary, n binary, m binary")
        counts = staged(asked.groupBy("range").applyInArrow(lambda x: _answer(x, end), f"chunk long, order int, range int, n binary, m binary, size long, {LONGS}"), "counts")
    sums = {c: x or 0 for c, x in counts.agg(*[F.sum(c).alias(c) for c in SUMS]).first().asDict().items()}
    answers = counts.select("chunk", "order", "range", "n", "m", "size").groupBy("chunk")
    out = chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers).applyInArrow(
        _scored(sums, to_arrow_type(field.dataType), bits), f"_id {kind}, n_tokens long, target_loss double, background_loss double, difference double"
    )
    return out.withColumnRenamed("_id", id_col)
