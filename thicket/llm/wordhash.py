"""64-bit hashes of words and word n-grams, computed with numpy over whole batches of texts (no per-word Python).

A word's hash is a polynomial in its bytes modulo 2**64, read off a running sum, then mixed.  Words are maximal runs of
bytes other than space and \\t \\n \\v \\f \\r.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 18
#: A run without white space longer than this is hashed on its own.
LONG_RUN = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 4096)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)))) for b in (np.uint64(BASE), np.uint64(_INV))]
    return _powers[0], _powers[1]


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def uniform(z: np.ndarray) -> np.ndarray:
    """Mixed 64-bit values as floats in (0, 1)."""
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _segment(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~SPACE[b]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _tables(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word."""
    b = np.frombuffer(data, dtype=np.uint8)
    parts, at = [], 0
    while at < len(b):
        stop = min(len(b), at + SEGMENT)
        if stop < len(b):
            back = np.flatnonzero(SPACE[b[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                while stop < len(b) and not SPACE[b[stop]]:
                    ahead = np.flatnonzero(SPACE[b[stop : stop + SEGMENT]])
                    stop = stop + int(ahead[0]) if len(ahead) else min(len(b), stop + SEGMENT)
        if stop - at > LONG_RUN:
            ws = np.flatnonzero(~SPACE[b[at:stop]])
            s, e = at + int(ws[0]), at + int(ws[-1]) + 1
            h = np.frombuffer(hashlib.blake2b(data[s:e], digest_size=8).digest(), dtype=np.uint64)
            parts.append((h, np.array([s]), np.array([e])))
        else:
            h, s, e = _segment(b[at:stop])
            parts.append((h, s + at, e + at))
        at = stop
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Batch:
    """The words of several texts, one after another; bounds[k]:bounds[k+1] are those of text k."""

    def __init__(self, texts: list[bytes]):
        self.hash, self.start, self.end = words(b"\n".join(texts))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.bounds = np.searchsorted(self.start, self.offset)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def ngrams(self, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of every run of n words of one text.  whole_if_short: a text of 1 to n-1 words
        gives one run, of all its words."""
        total = len(self.hash)
        own = self.owner()
        keep = np.flatnonzero(own[: max(0, total - n + 1)] == own[n - 1 :]) if total >= n else np.zeros(0, np.int64)
        h = rolled(self.hash, n)[keep] if len(keep) else np.zeros(0, np.uint64)
        at, who = keep, own[keep]
        if whole_if_short:
            short = np.flatnonzero((self.counts > 0) & (self.counts < n))
            if len(short):
                extra = np.array([rolled(self.hash[self.bounds[k] : self.bounds[k + 1]], int(self.counts[k]))[0] for k in short], dtype=np.uint64)
                h, who, at = np.concatenate((h, extra)), np.concatenate((who, short)), np.concatenate((at, self.bounds[short]))
                order = np.argsort(at, kind="stable")
                h, who, at = h[order], who[order], at[order]
        return h, who, at


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring values, in order."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : k + len(out)]
    return mix(out + np.uint64(n))


def polynomial(h: np.ndarray, n: int) -> np.ndarray:
    """Another hash of every n neighbouring values, independent of rolled(): read off a running sum of mixed values."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _tables(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h + np.uint64(BASE)) * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1] + np.uint64(n))
