"""Texts as sequences of independent segments, each encoded once.

A text is cut where no vocabulary entry can reach across the cut, so a document's ids are its segments' ids in a row.
Segments are identified by two 64-bit hashes in NumPy, and only unseen ones reach the encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * (out[k - 1] * base)
            k += m
    return out


def hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each segment; the segments are not empty and cover data."""
    lens = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lens)
    top = int(lens.max()) if len(lens) else 1
    return tuple(np.add.reduceat(_BYTE[k][data] * _powers(top, _BASE[k])[at], starts) for k in (0, 1))


class SegmentCache:
    """Ids by segment, for one encoder in one Python worker. Holds at most `bound` segments; beyond it, it starts anew."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bound: int = 1_200_000):
        self.encode, self.bound = encode, bound
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _put(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, number of ids of each segment)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        h1, h2 = hashes(data, starts)
        key, first, back = np.unique(h1, return_index=True, return_inverse=True)
        check = h2[first]
        if not np.array_equal(check[back], h2):  # different segments of one hash: all of this slice anew, one by one
            ends = np.append(starts[1:], len(data))
            return self.encode([data[s:e].tobytes() for s, e in zip(starts, ends)])
        if len(self.key) + len(key) > self.bound:
            self._clear()
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(len(self.key) - 1, 0))
        hit = (self.key[near] == key) & (self.check[near] == check) if len(self.key) else np.zeros(len(key), bool)
        start, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        start[hit], size[hit] = self.start[near[hit]], self.size[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            s = starts[first[new]]
            e = np.append(starts, len(data))[first[new] + 1]
            blob = data.tobytes()
            got, size[new] = self.encode([blob[i:j] for i, j in zip(s.tolist(), e.tolist())])
            start[new] = self.used + np.concatenate([[0], np.cumsum(size[new])[:-1]])
            self._put(got)
            fresh = new[(self.key[near[new]] != key[new])] if len(self.key) else new
            for name, values in (("key", key), ("check", check), ("start", start), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), at[fresh], values[fresh]))
        n = size[back]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1])
        take = np.arange(total, dtype=np.int64) + np.repeat(start[back] - (ends - n), n)
        return self.pool[take], n


def by_document(n: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Id offsets by document from ids by segment: no segment crosses a document."""
    total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return total[np.searchsorted(starts, offsets)]


def reach(pieces: Sequence[bytes]) -> np.ndarray:
    """256 x 256: whether some vocabulary entry holds byte x followed by byte y."""
    out = np.zeros((256, 256), bool)
    for p in pieces:
        b = np.frombuffer(p, np.uint8)
        out[b[:-1], b[1:]] = True
    return out
