"""A run-compressed Burrows-Wheeler index of a block of strings, and matching statistics from it.

Of the transform only its runs are kept: at the first row of each run, the text
position of that row, of the row above it, and the length of their common prefix.
Between sampled positions everything follows: if p is i behind the nearest sampled
position before it, the row above p's holds i more than that sample's, and their
common prefix is shorter by i. The same holds for the rows below, from the last row of
each run. So the longest match of each position elsewhere in the block (its matching
statistic against all other positions) streams from as many samples as there are runs,
which is few where strings repeat.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Text positions in the order of their suffixes, and ranks by the first 4, 8, 16... symbols (0 past the end).

    Ranks are refined by doubling; only positions whose rank is shared are sorted again.
    """
    n, width = len(text), 4
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    code = np.zeros(n, np.int64)
    for i in range(width):
        code = (code << 9) | padded[i : n + i]
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    fresh = np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    levels = [(width, rank.copy())]
    while True:
        shared = ~(fresh & np.append(fresh[1:], True))
        at = np.flatnonzero(shared)  # rows whose suffix is not yet told apart
        if not len(at):
            return order, levels
        p = order[at]
        ahead = p + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        key = rank[p] * (n + 2) + second
        again = np.argsort(key, kind="stable")
        p, key = p[again], key[again]
        order[at] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[at] = new
        rank = rank.copy()
        rank[p] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        width *= 2
        levels.append((width, rank))


def common_prefix(text: np.ndarray, levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of different suffixes."""
    n = len(text)
    length = np.zeros(len(p), np.int64)
    for width, rank in reversed(levels):
        while True:
            a, b = p + length, q + length
            same = (a + width <= n) & (b + width <= n)
            same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            if not same.any():
                break
            length[same] += width
    for _ in range(4):
        a, b = p + length, q + length
        same = (a < n) & (b < n)
        same &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
        length[same] += 1
    return length


class RunIndex:
    """Samples at the runs of the transform of one text of small non-negative symbols (below 511)."""

    def __init__(self, text: np.ndarray):
        text = text.astype(np.int64) + 1
        order, levels = suffix_order(text)
        self.n = len(text)
        before = text[order - 1]
        before[order == 0] = 0
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.runs = int(head.sum())
        # rows that begin a run, with the row above them; rows that end a run, with the row below them
        first = np.flatnonzero(head)[1:]
        up = common_prefix(text, levels, order[first], order[first - 1])
        self.up = self._samples(order[first], up, order[:1])
        self.down = self._samples(order[first - 1], up, order[-1:])

    @staticmethod
    def _samples(position: np.ndarray, length: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        position, length = np.concatenate([position, alone]), np.concatenate([length, np.zeros(len(alone), np.int64)])
        by = np.argsort(position)
        return position[by], length[by]

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts at another position."""
        every = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for position, length in (self.up, self.down):
            at = np.searchsorted(position, every, side="right") - 1
            known = at >= 0
            best = np.maximum(best, np.where(known, length[at] - (every - position[at]), 0))
        return best
