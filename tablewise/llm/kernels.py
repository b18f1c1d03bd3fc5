"""Numpy kernels over chunks of UTF-8 texts: words, span hashes, windows.

All hashes are 64 bit. A span hash is a polynomial over the bytes modulo 2^64,
read from prefix sums, then mixed; equal bytes give equal hashes at any place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown by doubling and kept."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(1 << 16, 1 << (n - 1).bit_length()), U)
        filled = 1
        while filled < len(out):
            out[filled:2 * filled] = out[:filled] * U(pow(base, filled, 1 << 64))
            filled *= 2
        _tables[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Hasher:
    """Span hashes of one byte buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * _powers(_BASE, max(n, 1))[:n], out=self.sums[1:])
        self.inverse = _powers(_BASE_INV, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all k-byte windows, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U)
        raw = (self.sums[k:] - self.sums[:n]) * self.inverse[:n]
        return mix(raw ^ U((k * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of runs of about ``most`` bytes; null counts as empty.

    A longer text makes a run of its own, so memory follows the longest text.
    """
    first, held, size = 0, [], 0
    for i, scalar in enumerate(column.cast(pa.large_binary())):
        text = scalar.as_py() or b""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


class Words:
    """The words of several texts: places, text number and hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.inside = ~_SPACE[self.buf]
        edge = np.diff(np.concatenate(([0], self.inside.view(np.int8), [0])))
        self.w0, self.w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.starts, self.w0, "right") - 1
        # words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.w0, np.append(self.starts, len(self.buf)))
        self.hasher = Hasher(self.buf)

    def hashes(self) -> np.ndarray:
        return self.hasher.spans(self.w0, self.w1)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text carry a flag."""
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[self.ends] - c[self.starts]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes, by first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(n * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
    for i in range(n):
        out = out * U(0x9FB21C651E98DF25) + h[i:i + m]
    return mix(out)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; is it equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(s) else False
    return many, later


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the runs of ``length`` that begin at ``starts``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0
