"""Max-plus parallel scan: the best segmentation of a text, chunk by chunk.

A segmentation's boundary state at a chunk edge is how far the piece that crosses
it reaches into the next chunk. A chunk's transfer matrix holds, for every state
on its left and right edge, the best score in between. These matrices combine
associatively (max of sums), so chunks can be scored apart from each other; given the
states on its edges, each chunk is then traced back on its own. ``segment`` does all
this in one worker.
"""

from __future__ import annotations

import numpy as np

NONE = -np.inf


class Pieces:
    """A unigram vocabulary: piece to score; a character without a piece scores ``unknown``."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores = dict(scores)
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0 if unknown is None else unknown

    def edges(self, text: str, at: int):
        """Pieces that start at a place, as (length, score)."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            s = self.scores.get(text[at : at + n])
            if s is not None:
                yield n, s
            elif n == 1:
                yield 1, self.unknown


def forward(text: str, start: int, end: int, entry: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best scores from ``start + entry`` to every place up to ``end + longest``; and the last piece's length."""
    size = end - start + pieces.longest + 1
    best, last = np.full(size, NONE), np.zeros(size, np.int64)
    best[entry] = 0.0
    for i in range(entry, end - start):
        if best[i] > NONE:
            for n, s in pieces.edges(text, start + i):
                if best[i] + s > best[i + n] or best[i] + s == best[i + n] and n > last[i + n]:
                    best[i + n], last[i + n] = best[i] + s, n
    return best, last


def transfer(text: str, start: int, end: int, pieces: Pieces) -> np.ndarray:
    """The chunk's matrix of best scores between boundary states."""
    states = pieces.longest
    m = np.full((states, states), NONE)
    for entry in range(states):
        if entry >= end - start:  # a piece reaches past the whole chunk
            if entry - (end - start) < states:
                m[entry, entry - (end - start)] = 0.0
        else:
            m[entry] = forward(text, start, end, entry, pieces)[0][end - start : end - start + states]
    return m


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by doubling: log-many rounds of independent products."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [combine(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The best segmentation's state on every chunk edge; it starts and ends in state 0."""
    prefixes = scan(matrices)
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefixes[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *reversed(states)] if matrices else [0]


def backtrace(text: str, start: int, end: int, entry: int, exit_state: int, pieces: Pieces) -> list[str]:
    """The chunk's own pieces between its two states."""
    if entry >= end - start:
        return []
    _, last = forward(text, start, end, entry, pieces)
    at, found = end - start + exit_state, []
    while at > entry:
        found.append(text[start + at - last[at] : start + at])
        at -= last[at]
    return found[::-1]


def segment(text: str, pieces: Pieces, chunk: int = 4096) -> list[str]:
    """The best segmentation of a text, through chunks of ``chunk`` characters."""
    cuts = [(i, min(i + chunk, len(text))) for i in range(0, len(text), chunk)]
    states = boundary_states([transfer(text, a, b, pieces) for a, b in cuts])
    return [p for (a, b), s, t in zip(cuts, states, states[1:]) for p in backtrace(text, a, b, s, t, pieces)]
