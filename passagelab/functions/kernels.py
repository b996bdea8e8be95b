"""Search kernels over one series in memory, in numpy.

All return, for positions ``0..N-1``, the first later position whose value is at
least the target, or -1.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAST = np.iinfo(np.int64).min


class MaxTree:
    """A padded binary tree of maxima; node k has the children 2k and 2k+1."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.width = 1 << max(0, (n - 1).bit_length())
        self.node = np.full(2 * self.width, LEAST, np.int64)
        self.node[self.width : self.width + n] = values
        w = self.width
        while w > 1:
            below = self.node[w : 2 * w]
            self.node[w // 2 : w] = np.maximum(below[0::2], below[1::2])
            w //= 2

    def first_at_least(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each query the leftmost position from ``start`` on with a value of at least ``target``."""
        out = np.full(len(start), -1, np.int64)
        asked = np.flatnonzero(start < self.width)
        at, want = start[asked] + self.width, target[asked]
        # the widest subtree that begins at the start
        at >>= np.log2(at & -at).astype(np.int64)
        while len(asked):
            hit = self.node[at] >= want
            self._descend(asked[hit], at[hit], want[hit], out)
            at = at[~hit] + 1
            asked, want = asked[~hit], want[~hit]
            inside = (at & (at - 1)) != 0
            at, asked, want = at[inside], asked[inside], want[inside]
            at >>= np.log2(at & -at).astype(np.int64)
        return out

    def _descend(self, asked, at, want, out) -> None:
        while True:
            inner = at < self.width
            if not inner.any():
                break
            left = 2 * at[inner]
            at[inner] = np.where(self.node[left] >= want[inner], left, left + 1)
        out[asked] = at - self.width


def tree_search(q: np.ndarray, d: int, tree: MaxTree | None = None) -> np.ndarray:
    tree = tree or MaxTree(q)
    return tree.first_at_least(np.arange(1, len(q) + 1), q + d)


def heap_search(q: np.ndarray, d: int) -> np.ndarray:
    """The order of arrival: a heap of pending targets, resolved by each new value."""
    out, pending = np.full(len(q), -1, np.int64), []
    for i, v in enumerate(q.tolist()):
        while pending and pending[0][0] <= v:
            out[heapq.heappop(pending)[1]] = i
        heapq.heappush(pending, (v + d, i))
    return out


def sweep_many(q: np.ndarray, ds) -> np.ndarray:
    """Positions for many thresholds in one sweep over blocks of 1, 2, 4, … values, a row for each threshold.

    At each width an index in a left block that found nothing so far looks at the
    running maxima of the block to its right, which all thresholds share.
    """
    n = len(q)
    width = 1 << max(0, (n - 1).bit_length())
    padded = np.full(width, LEAST, np.int64)
    padded[:n] = q
    out = np.full(len(ds) * n, -1, np.int64)
    slot = np.arange(len(out))
    at, want = np.tile(np.arange(n), len(ds)), (q[None, :] + np.asarray(ds, np.int64)[:, None]).ravel()
    w = 1
    while w < width and len(slot):
        running = np.maximum.accumulate(padded.reshape(-1, w), axis=1)
        block = at // w
        ends = np.flatnonzero((block % 2 == 0) & (running[np.minimum(block + 1, len(running) - 1), -1] >= want))
        right, target = block[ends] + 1, want[ends]
        place, span = np.zeros(len(ends), np.int64), w
        while span > 1:
            span //= 2
            place += span * (running[right, place + span - 1] < target)
        out[slot[ends]] = right * w + place
        rest = np.ones(len(slot), bool)
        rest[ends] = False
        slot, at, want = slot[rest], at[rest], want[rest]
        w *= 2
    return out.reshape(len(ds), n)


def sweep_search(q: np.ndarray, d: int) -> np.ndarray:
    return sweep_many(q, [d])[0]
