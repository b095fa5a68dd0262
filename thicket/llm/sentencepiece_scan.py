"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant texts.

The model is byte-pair encoding, so the best segmentation isn't the one with the largest sum of piece scores.  It is the
one path of pieces in which every two neighbours are compatible, that is, encoding the two pieces' joined text gives
those two pieces again.  Weight 0 for a compatible step and -inf for any other turns this into a max-plus problem with
exactly one path of weight 0:

* A giant text is cut into chunks at fixed distances, wherever that falls.  The state at a cut is the piece that covers
  or touches it and how far the piece reaches beyond; neighbouring chunks list the same states from the text around.
* Each chunk yields its transfer matrix (states at its start x states at its end, 0 or -inf, kept as bits).
* Neighbouring matrices are multiplied (max-plus products are associative): FAN chunks make a segment, FAN segments the
  next larger one, until one matrix stands for the whole text.  Its only finite entry gives the states at both ends.
* On the way back, a segment with known end states tells its FAN parts theirs: at each cut between them exactly one state
  is finite both from the left and to the right.
* With both end states known, each chunk is backtraced on its own, in parallel with the others.

A task never holds more than FAN matrices or a few chunks, however long the text is, until its token ids are put together.

Inside a chunk, no piece goes past the start of a run of spaces (checked when the model is loaded), so between the first
and last such places the path doesn't depend on the state and the library's own encoder gives it; elsewhere, and in texts
without spaces, the path is swept piece by piece.  Texts of up to GIANT characters go to the library whole.  A model that
changes texts before it cuts them (normalises) is refused, as chunks couldn't do the same.

Null counts as empty; empty texts have no tokens.  Decoding gives the text back exactly, except that U+2581, which the
model can't tell from a space, comes back as a space.  Every row is encoded on its own: rows that repeat, or tie in their
id, come out as often as they go in; an empty table gives an empty result; columns other than the id's and the text's are
not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, few_rows, staged, texts_of, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts with more characters are encoded in chunks.
GIANT = 32_768
CHUNK = 8_192
#: Neighbouring matrices that are multiplied in one task.
FAN = 32
#: Bytes of text that are encoded at once.
AT_ONCE = 250_000
REMEMBERED = 1 << 14
#: Places where a normaliser would show: each is encoded between two letters.
PROBES = [*map(chr, range(1, 0x3100)), "  ", "   ", " \t ", "\r\n", "e\u0301", "\uac00", "\uff21", "\ufb01", "\U0001f600"]
State = tuple[int, str]  # characters beyond the cut, piece


class Vocabulary:
    """The pieces of a model, for the sweep, with the library's processor."""

    def __init__(self, proto: bytes):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        probe = "a".join(PROBES).replace(SPACE, "")
        if p.normalize(f" {probe} ") != SPACE + f" {probe} ".replace(" ", SPACE):
            raise ValueError("the model normalises its texts")
        ordinary = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in ordinary}
        self.scores = {p.id_to_piece(i): p.get_score(i) for i in ordinary}
        self.longest = max(map(len, self.ids))
        self.cuts_at_space = not any(SPACE in s.lstrip(SPACE) for s in self.ids)
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.compatible = functools.lru_cache(REMEMBERED)(self._compatible)

    def bpe(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text: join the neighbours with the best score, leftmost first, until none fit."""
        parts: list[str | None] = list(text)
        right = [*range(1, len(parts)), -1]
        left = [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := parts[a] + parts[b]) in self.scores:
                heapq.heappush(heap, (-self.scores[joined], a, b, joined))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in parts if x is not None]

    def _compatible(self, a: str, b: str) -> bool:
        return self.bpe(a + b) == ([a, b] if a else [b])

    def token_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for x in pieces:
            known = self.ids.get(x)
            out += [known] if known is not None else [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")]
        return out

    def starting_at(self, text: str, at: int) -> list[str]:
        """Pieces that match at this place; a character outside the vocabulary is a piece of its own."""
        found = [s for n in range(1, min(self.longest, len(text) - at) + 1) if (s := text[at : at + n]) in self.ids]
        return found if found and len(found[0]) == 1 else [text[at], *found]

    def states(self, text: str, cut: int) -> list[State]:
        """Every (reach, piece) that begins before the cut and ends at it or beyond."""
        if cut == 0:
            return [(0, "")]
        out = []
        for start in range(max(0, cut - self.longest), cut):
            out += [(start + len(s) - cut, s) for s in self.starting_at(text, start) if start + len(s) >= cut]
        return sorted(out) if cut < len(text) else sorted(x for x in out if x[0] == 0)

    def sweep(self, text: str, sources: list[tuple[int, str]], stop: int) -> tuple[dict, dict]:
        """Follow compatible pieces from each (end, piece) in sources until they reach `stop` or beyond.
        Returns {(end, piece): bits of the sources that reach it} and {(end, piece): {(end, piece) before it}}."""
        waiting: dict[int, dict[str, int]] = {}
        done: dict[tuple[int, str], int] = {}
        before: dict[tuple[int, str], set] = {}
        for k, (end, piece) in enumerate(sources):
            at = done if end >= stop else waiting.setdefault(end, {})
            key = (end, piece) if end >= stop else piece
            at[key] = at.get(key, 0) | 1 << k
        heap = list(waiting)
        heapq.heapify(heap)
        while heap:
            at = heapq.heappop(heap)
            for piece, bits in waiting.pop(at).items():
                for s in self.starting_at(text, at):
                    if self.compatible(piece, s):
                        end = at + len(s)
                        before.setdefault((end, s), set()).add((at, piece))
                        if end >= stop:
                            done[end, s] = done.get((end, s), 0) | bits
                        else:
                            if end not in waiting:
                                waiting[end] = {}
                                heapq.heappush(heap, end)
                            waiting[end][s] = waiting[end].get(s, 0) | bits
        return done, before

    def fixed_ends(self, text: str, low: int, high: int) -> tuple[int, int]:
        """First and last place in [low, high] where a run of spaces starts; (-1, -1) if there are fewer than two."""
        if not self.cuts_at_space:
            return -1, -1
        first = low
        while (first := text.find(SPACE, first, high)) > 0 and text[first - 1] == SPACE:
            first += 1
        last = high
        while (last := text.rfind(SPACE, low, last)) > 0 and text[last - 1] == SPACE:
            pass
        return (first, last) if 0 < first < last else (-1, -1)

    def matrix(self, text: str, start: int, stop: int) -> np.ndarray:
        """Transfer matrix of text[start:stop] as booleans (True: weight 0, False: -inf)."""
        into, out = self.states(text, start), self.states(text, stop)
        sources = [(start + o, s) for o, s in into]
        a, b = self.fixed_ends(text, start + self.longest, stop)
        if a < 0:
            done, _ = self.sweep(text, sources, stop)
            return np.array([[bool(done.get((stop + o, s), 0) >> k & 1) for o, s in out] for k in range(len(into))], dtype=bool).reshape(len(into), len(out))
        head, _ = self.sweep(text, sources, a)
        tail, _ = self.sweep(text, [(b, "")], stop)
        bits = functools.reduce(lambda x, y: x | y, (v for (end, _), v in head.items() if end == a), 0)
        enters = np.array([bool(bits >> k & 1) for k in range(len(into))], dtype=bool)
        leaves = np.array([(stop + o, s) in tail for o, s in out], dtype=bool)
        return enters[:, None] & leaves[None, :]

    def walk(self, text: str, source: tuple[int, str], goal: tuple[int, str] | int) -> list[str]:
        """The pieces after `source` up to `goal` (a piece with its end, or a place that a piece ends at)."""
        stop = goal if isinstance(goal, int) else max(source[0], goal[0] - len(goal[1]) + 1)
        done, before = self.sweep(text, [source], stop)
        at = next(k for k in done if (k[0] == goal if isinstance(goal, int) else k == goal))
        pieces = []
        while at != source:
            pieces.append(at[1])
            at = next(iter(before[at]))
        return pieces[::-1]

    def backtrace(self, text: str, start: int, stop: int, into: State, out: State) -> list[int]:
        """Token ids of the pieces that end after the first state's piece, up to the last state's."""
        source, goal = (start + into[0], into[1]), (stop + out[0], out[1])
        if source == goal:
            return []
        a, b = self.fixed_ends(text, start + self.longest, stop)
        if a < 0:
            return self.token_ids(self.walk(text, source, goal))
        middle = self.processor.encode(text[a + 1 : b].replace(SPACE, " "))
        return [*self.token_ids(self.walk(text, source, a)), *middle, *self.token_ids(self.walk(text, (b, ""), goal))]

    def encode_in_chunks(self, text: str, size: int = CHUNK) -> list[int]:
        """The whole scan in one process; the Spark job does the same steps apart."""
        if not text:
            return []
        s = SPACE + text.replace(" ", SPACE)
        cuts = [*range(0, len(s), size), len(s)]
        path = combine([self.matrix(s, a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
        states = [self.states(s, c)[k] for c, k in zip(cuts, path, strict=True)]
        return [t for a, b, x, y in zip(cuts, cuts[1:], states, states[1:], strict=False) for t in self.backtrace(s, a, b, x, y)]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product of matrices with entries 0 (True) and -inf (False), by pairs of neighbours."""
    while len(matrices) > 1:
        pairs = [(a @ b if len(a) else a) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def only(finite: np.ndarray) -> int:
    found = np.flatnonzero(finite)
    if len(found) != 1:
        raise ValueError("the segmentation is not unique: not a byte-pair model")
    return int(found[0])


def inner_states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The state at every cut of neighbouring parts, whose states at both ends are known."""
    forward = [np.arange(len(matrices[0])) == first]
    for m in matrices[:-1]:
        forward.append((forward[-1][:, None] & m).any(axis=0))
    out, right = [last], np.arange(matrices[-1].shape[1]) == last
    for m, left in zip(reversed(matrices), reversed(forward), strict=True):
        right = (m & right[None, :]).any(axis=1)
        out.append(only(left & right))
    return out[::-1]


def combine(matrices: list[np.ndarray], fan: int = FAN) -> list[int]:
    """The state at every cut: up by products of `fan` neighbours, down again by the states at their ends."""
    if len(matrices) == 1:
        return [0, only(matrices[0][0])]
    parts = [matrices[k : k + fan] for k in range(0, len(matrices), fan)]
    ends = combine([product(x) for x in parts], fan)
    return [0, *(s for x, a, b in zip(parts, ends, ends[1:], strict=False) for s in inner_states(x, a, b)[1:])]


_loaded: dict[bytes, sentencepiece.SentencePieceProcessor | Vocabulary] = {}


def processor(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    """One processor at a time in each process."""
    key = b"processor" + hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return _loaded[key]


def vocabulary(proto: bytes) -> Vocabulary:
    """One Vocabulary at a time in each process."""
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(proto)
    return _loaded[key]


def _forget() -> None:
    _loaded.clear()


def _light(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f as by tidy(); the model goes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _forget()

    return tidy(run)


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver; executors get its bytes by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def _int_lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate([np.array(x, dtype=np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sub_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in byte_chunks(batch.column(text), AT_ONCE):
            yield batch.slice(start, stop - start)


def _matrix_columns(found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([np.packbits(m).tobytes() for m in found], pa.binary()), *(pa.array([m.shape[k] for m in found], pa.int32()) for k in (0, 1))]


def _matrices(group: pa.Table) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x, np.uint8), count=n * m).reshape(n, m).astype(bool) for x, n, m in zip(*(group.column(c).to_pylist() for c in ("bits", "n_in", "n_out")), strict=True)]


def _segment(group: pa.Table) -> pa.Table:
    """The product of neighbouring matrices."""
    row, k = group.column("_row")[0], group.column("_up")[0]
    return pa.table([pa.array([row.as_py()]), pa.array([k.as_py()], pa.int32()), *_matrix_columns([product(_matrices(group.sort_by("_k")))])], names=["_row", "_k", "bits", "n_in", "n_out"])


def _settled(group: pa.Table) -> pa.Table:
    """The states at both ends of neighbouring parts, from those of the segment that they make."""
    group = group.sort_by("_k")
    path = inner_states(_matrices(group), group.column("first")[0].as_py(), group.column("last")[0].as_py())
    return pa.table({"_row": group.column("_row"), "_k": group.column("_k"), "s_in": pa.array(path[:-1], pa.int32()), "s_out": pa.array(path[1:], pa.int32())})


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = [only(m[0]) for m in _matrices(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())], names=["_row", "_k", "s_in", "s_out"])


def _states(chunks: DataFrame, fan: int) -> DataFrame:
    """(_row, _k, s_in, s_out) of every chunk, from (_row, _k, bits, n_in, n_out): a scan over a tree of segments."""
    matrix, levels = "_row long, _k int, bits binary, n_in int, n_out int", [chunks]
    up = F.floor(F.col("_k") / fan).cast("int")
    while levels[-1].where("_k > 0").limit(1).count():
        levels.append(staged(levels[-1].withColumn("_up", up).groupBy("_row", "_up").applyInArrow(_segment, matrix), "segments"))
    states = levels.pop().mapInArrow(tidy(_top), "_row long, _k int, s_in int, s_out int")
    for level in reversed(levels):
        ends = states.select("_row", F.col("_k").alias("_up"), F.col("s_in").alias("first"), F.col("s_out").alias("last"))
        states = staged(level.withColumn("_up", up).join(ends, ["_row", "_up"]).groupBy("_row", "_up").applyInArrow(_settled, "_row long, _k int, s_in int, s_out int"), "states")
    return states


def _large(df: DataFrame, proto, chunk: int, fan: int) -> DataFrame:
    """(_id, ids) of the rows (_id, _text), by chunks."""
    spark, kind = df.sparkSession, df.schema["_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk carries the text around it as far as a piece can reach; only at the text's own ends nothing follows
        reach = vocabulary(proto.value).longest + 1
        for batch in _sub_batches(batches, 1):
            for own, t, row in zip(*(batch.column(k) for k in range(3)), strict=True):
                s = SPACE + t.as_py().replace(" ", SPACE)
                starts = range(0, len(s), chunk)
                lows = [max(0, a - reach) for a in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.as_py()] * len(lows), pa.int64()),
                        pa.array(range(len(lows)), pa.int32()),
                        pa.array([s[low : a + chunk + reach] for a, low in zip(starts, lows, strict=True)], pa.string()),
                        pa.array([a - low for a, low in zip(starts, lows, strict=True)], pa.int32()),
                        pa.array([min(len(s), a + chunk) - low for a, low in zip(starts, lows, strict=True)], pa.int32()),
                        pa.array([own.as_py()] * len(lows), batch.schema.field(0).type),
                    ],
                    names=["_row", "_k", "_s", "_a", "_b", "_id"],
                )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in batches:
            found = [v.matrix(s, a, b) for s, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_matrix_columns(found)], names=["_row", "_k", "bits", "n_in", "n_out"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto.value)
        for batch in batches:
            ids = []
            for s, a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                ids.append(v.backtrace(s, a, b, v.states(s, a)[x], v.states(s, b)[y]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _int_lists(ids)], names=["_row", "_k", "ids"])

    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    with few_rows(spark, 64):
        pieces = staged(numbered.mapInArrow(_light(split), f"_row long, _k int, _s string, _a int, _b int, _id {kind}"), "chunks")
        plain = pieces.select("_row", "_k", "_s", "_a", "_b").repartition(F.col("_row"), F.col("_k"))
        found = staged(plain.mapInArrow(_light(matrices), "_row long, _k int, bits binary, n_in int, n_out int"), "matrices")
        states = _states(found, fan)
        traced = staged(pieces.select("_row", "_k", "_s", "_a", "_b").join(states, ["_row", "_k"]).mapInArrow(_light(trace), "_row long, _k int, ids array<int>"), "traced")
    together = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return pieces.where("_k = 0").select("_row", "_id").join(together, "_row").select("_id", "ids")


def _parts(df: DataFrame, text: str, id_col: str, giant: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _text) of the texts that go to the library whole, and of the others."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.where(F.length("_text") <= giant), rows.where(F.length("_text") > giant)


def encode(df: DataFrame, text: str = "text", id_col: str = "doc_id", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(id_col, ids) of every row of df; ids is array<int>."""
    proto = df.sparkSession.sparkContext.broadcast(read_model(model))
    small, big = _parts(df, text, id_col, giant)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(proto.value)
        for batch in _sub_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _int_lists(p.encode(texts_of(batch.column(1)), num_threads=1))], names=["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    coded = small.mapInArrow(_light(whole), f"_id {kind}, ids array<int>")
    return coded.union(_large(big, proto, chunk, fan)).withColumnRenamed("_id", id_col)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, and `text` from the token ids (null ids: empty)."""
    proto = df.sparkSession.sparkContext.broadcast(read_model(model))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(proto.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                texts = p.decode([x or [] for x in part.column(len(keep)).to_pylist()], num_threads=1) if part.num_rows else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return df.select(*keep, ids).mapInArrow(_light(back), f"{schema}, text string")


def digest(df: DataFrame, text: str = "text", id_col: str = "doc_id", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """id_col, n_tokens, ids_crc (of the ids joined by spaces) and decoded_sha256, as from encode() and decode().  Texts
    that go to the library whole are encoded, decoded and digested in one pass, so their ids never leave the worker."""
    proto = df.sparkSession.sparkContext.broadcast(read_model(model))
    kind = df.schema[id_col].dataType.simpleString()
    small, big = _parts(df, text, id_col, giant)

    def digests(p: sentencepiece.SentencePieceProcessor, own: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        crc = [zlib.crc32(" ".join(map(str, x)).encode()) for x in ids]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in p.decode(ids, num_threads=1)] if ids else []
        return pa.RecordBatch.from_arrays([own, pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["_id", "n_tokens", "ids_crc", "decoded_sha256"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(proto.value)
        for batch in _sub_batches(batches, 1):
            yield digests(p, batch.column(0), p.encode(texts_of(batch.column(1)), num_threads=1))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(proto.value)
        for batch in batches:
            for k in range(batch.num_rows):
                yield digests(p, batch.column(0).slice(k, 1), batch.column(1).slice(k, 1).to_pylist())

    schema = f"_id {kind}, n_tokens long, ids_crc long, decoded_sha256 string"
    out = small.mapInArrow(_light(whole), schema).union(_large(big, proto, chunk, fan).mapInArrow(_light(coded), schema))
    return out.withColumnRenamed("_id", id_col)
