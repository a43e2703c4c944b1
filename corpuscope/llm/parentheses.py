"""Trees as balanced parentheses.

A tree in preorder is a sequence of brackets, one pair per node. The excess (opened less closed) falls
below that of an opening bracket at the bracket that closes it; ``findclose`` looks for that place in
the node's own block of brackets, then climbs and descends a tree of the blocks' smallest excesses.
All nodes are looked up at once, level by level of that tree.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """The brackets of a tree, from the depths of its nodes in preorder; the first is the root, 0."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.depth = depth.astype(np.int64)
        # Before a node all nodes before it were opened, and all of these but its ancestors closed.
        self.open = 2 * np.arange(n, dtype=np.int64) - self.depth
        self.bits = np.zeros(2 * n, dtype=bool)
        self.bits[self.open] = True
        blocks = -(-2 * n // BLOCK)
        self.excess = np.full(blocks * BLOCK, n + 1, dtype=np.int32)  # beyond the end nothing is small
        self.excess[: 2 * n] = np.cumsum(np.where(self.bits, 1, -1))
        self.levels = [self.excess.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            even = np.append(last, n + 1) if len(last) % 2 else last
            self.levels.append(even.reshape(-1, 2).min(axis=1))
        leaf = self.bits.copy()
        leaf[:-1] &= ~self.bits[1:]
        #: Leaf pairs before each bracket.
        self.leaves_before = np.append(0, np.cumsum(leaf))

    def _in_block(self, block: np.ndarray, least: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first place in a block, after ``after``, with an excess of ``least`` at most; -1 without."""
        out = np.full(len(block), -1, dtype=np.int64)
        step = 1 << 16
        for s in range(0, len(block), step):
            b = block[s : s + step, None] * BLOCK + np.arange(BLOCK)
            hit = (self.excess[b] <= least[s : s + step, None]) & (b > after[s : s + step, None])
            first = hit.argmax(axis=1)
            rows = np.arange(len(first))
            out[s : s + step] = np.where(hit[rows, first], b[rows, first], -1)
        return out

    def findclose(self) -> np.ndarray:
        """The closing bracket of every node."""
        least = self.excess[self.open] - 1
        own = self.open // BLOCK
        close = self._in_block(own, least, self.open)
        todo = np.flatnonzero(close < 0)
        if not len(todo):
            return close
        want, at, level = least[todo], own[todo], 0
        found_level = np.full(len(todo), -1)
        found = np.zeros(len(todo), dtype=np.int64)
        while (found_level < 0).any():  # climb to the first block to the right that goes low enough
            right = at + 1
            there = (found_level < 0) & (at % 2 == 0) & (right < len(self.levels[level]))
            low = there.copy()
            low[there] = self.levels[level][right[there]] <= want[there]
            found[low], found_level[low] = right[low], level
            at, level = at // 2, level + 1
        for level in range(int(found_level.max()), 0, -1):  # and down to its first such child
            here = np.flatnonzero(found_level >= level)
            left = 2 * found[here]
            found[here] = left + (self.levels[level - 1][left] > want[here])
        close[todo] = self._in_block(found, want, np.full(len(todo), -1))
        return close

    def parents(self) -> np.ndarray:
        """The node that encloses each node; -1 for the root."""
        n = len(self.depth)
        places = np.arange(n)
        order = np.lexsort((places, self.depth))
        key = self.depth[order] * n + order
        at = np.searchsorted(key, (self.depth - 1) * n + places) - 1
        return np.where(self.depth > 0, order[np.maximum(at, 0)], -1)


def subtree_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of all nodes, from one cumulative array in preorder."""
    before = np.append(0, np.cumsum(values))
    at = np.arange(len(values))
    return before[at + sizes] - before[at]
