"""Vectorised text primitives over Arrow batches: word spans, 64-bit word hashes, shingle hashes.

A word is a run of bytes other than ASCII white space (space, tab to carriage return); A-Z is lower-cased.
Batches are worked on in chunks of bounded size, so memory follows the chunk or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Of a byte: 0 white space, 1 letter or part of a character beyond ASCII, 2 digit, 3 punctuation or control.
_KIND = np.array([0 if c == 32 or 9 <= c <= 13 else 2 if 48 <= c <= 57 else 1 if c >= 128 or chr(c).isalpha() else 3 for c in range(256)], dtype=np.uint8)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to n at least."""
    if len(_POW.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (k or more of them)."""
    n = len(h) - k + 1
    run = h[:n].copy()
    for j in range(1, k):
        run *= np.uint64(_BASE)
        run += h[j : n + j]
    return mix(run)


class Words:
    """Words of consecutive texts: byte spans, hashes, and each text's first word (``first``, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray):
        self.rows = rows
        self.data = data = data + ((data >= 65) & (data <= 90)).view(np.uint8) * np.uint8(32)
        self.offsets = offsets
        n = len(data)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = solid
        before[offsets] = False
        after = np.zeros(n + 1, dtype=bool)
        after[:-1] = solid
        after[offsets] = False
        self.starts = np.flatnonzero(solid & ~before[:-1])
        self.ends = np.flatnonzero(solid & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def spans_hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-cased byte spans."""
        if not hasattr(self, "_total"):
            n = len(self.data)
            self._total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(n + 1)[0][:n], out=self._total[1:])
        return mix((self._total[ends] - self._total[starts]) * _powers(len(self.data) + 1)[1][starts])

    @property
    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.spans_hashed(self.starts, self.ends)
        return self._hashes

    def stems(self, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Word spans without up to ``rounds`` bytes of ASCII punctuation at either end (one byte stays)."""
        d, starts, ends = self.data, self.starts.copy(), self.ends.copy()
        for _ in range(rounds):
            starts += (_KIND[d[starts]] == 3) & (ends - starts > 1)
            ends -= (_KIND[d[ends - 1]] == 3) & (ends - starts > 1)
        return starts, ends

    def shapes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span's class of length and of whether it has digits, punctuation, other than ASCII."""
        code = np.digitize(ends - starts, (4, 8, 13)).astype(np.uint64)
        for has in (_KIND[self.data] == 2, _KIND[self.data] == 3, self.data >= 128):
            total = np.zeros(len(self.data) + 1, dtype=np.int64)
            np.cumsum(has, out=total[1:])
            code = code * np.uint64(2) + (total[ends] > total[starts]).astype(np.uint64)
        return mix(code + np.uint64(1))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of one kind inside words (letters, digits, punctuation): starts, ends, each text's first run."""
        kind = _KIND[self.data]
        new = np.ones(len(kind) + 1, dtype=bool)
        new[1:-1] = kind[1:] != kind[:-1]
        new[self.offsets] = True
        at = np.flatnonzero(new)
        starts, ends = at[:-1], at[1:]
        solid = kind[starts] != 0 if len(starts) else np.zeros(0, dtype=bool)
        starts, ends = starts[solid], ends[solid]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def points(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points before byte ``at`` in its text."""
        before = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=before[1:])
        return before[at] - before[self.offsets[text]]

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def shingles(self, k: int) -> Iterator[np.ndarray]:
        """For each text its k-word shingle hashes in order (int64); fewer words: the whole sequence as one."""
        h = self.hashes
        if len(h) >= k:
            run = rolled(h, k).view(np.int64)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= k:
                yield run[a : b - k + 1]
            elif b > a:
                x = int(b - a)
                for v in h[a:b].tolist():
                    x = (x * 0xD6E8FEB86659FD93 + v + 1) & _MASK
                yield mix(np.array([x], dtype=np.uint64)).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The texts of a string column (null: empty) as Words, a bounded number of bytes at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, len(column))
        yield Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], np.arange(at, to))
        at = to
