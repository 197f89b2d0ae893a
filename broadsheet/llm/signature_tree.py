"""Signature trees over token sets: OR-combined bitmaps and size ranges, joined by a dual traversal.

A leaf entry is one set: a bitmap with one bit per token hash, its size, and its slack (size minus set bits, the tokens
that share a bit with another). A node holds the OR of its entries' bitmaps, their least and greatest size and their
greatest slack. For x below node A and y below node B, |x & y| <= popcount(A & B) + min(slack A, slack B), so a pair of
nodes is left as soon as this bound, or the size ranges, cannot reach the wanted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 2048
FANOUT = 8
#: Node pairs compared in one vectorised step.
STEP = 1 << 14


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    flags = np.zeros(bits, np.uint8)
    flags[(tokens >> np.uint64(7)) % np.uint64(bits)] = 1
    return np.packbits(flags).view(np.uint64)


class Tree:
    """Levels from the entries (level 0) to a single root; ``order`` maps entries to the input's positions."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, sort_keys: np.ndarray):
        self.order = np.lexsort((sort_keys, sizes))
        bits, sizes = bitmaps[self.order], sizes[self.order].astype(np.int64)
        slack = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Position pairs (i, j) whose sets may have a Jaccard similarity of num / den or more; each pair once."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > STEP:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            bits, low, high, slack = self.levels[level]
            fit = (den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a])
            a, b = a[fit], b[fit]
            common = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(slack[a], slack[b])
            common = np.minimum(common, np.minimum(high[a], high[b]))
            # |x & y| >= num / (num + den) * (|x| + |y|) is the same as Jaccard >= num / den.
            fit = (num + den) * common >= num * (low[a] + low[b])
            a, b = a[fit], b[fit]
            if not len(a):
                continue
            if level == 0:
                off = a != b
                if off.any():
                    yield self.order[a[off]], self.order[b[off]]
                continue
            below = len(self.levels[level - 1][0])
            kids = np.arange(FANOUT)
            left = (a[:, None] * FANOUT + kids)[:, :, None] + np.zeros(FANOUT, np.int64)
            right = (b[:, None] * FANOUT + kids)[:, None, :] + np.zeros((FANOUT, 1), np.int64)
            ok = (left < below) & (right < below) & (left <= right)
            left, right = left[ok], right[ok]
            stack.append((level - 1, left, right))


class Union:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum()) if len(y) else 0
