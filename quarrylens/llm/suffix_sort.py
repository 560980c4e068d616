"""Sorting text ends by hash comparisons.

Strings are compared by the length of their common beginning, found by binary
search over prefix polynomial hashes; a merge sort over these logarithmic
comparisons orders all strings of all groups at once, level by level.
"""

from __future__ import annotations

import numpy as np

#: An odd base; hashes are taken modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Ends:
    """Strings (rows of a padded byte matrix) with prefix hashes."""

    def __init__(self, padded: np.ndarray, length: np.ndarray):
        self.bytes, self.length = padded, length
        m, width = padded.shape
        self.hash = np.zeros((m, width + 1), np.uint64)
        acc = np.zeros(m, np.uint64)
        for j in range(width):
            acc = acc * BASE + (padded[:, j].astype(np.uint64) + np.uint64(1))
            self.hash[:, j + 1] = acc

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the strings i and j."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        for _ in range(int(self.bytes.shape[1]).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash[i, mid] == self.hash[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i comes strictly before string j."""
        at = self.common(i, j)
        ended = at >= np.minimum(self.length[i], self.length[j])
        last = self.bytes.shape[1] - 1
        x, y = self.bytes[i, np.minimum(at, last)], self.bytes[j, np.minimum(at, last)]
        return np.where(ended, self.length[i] < self.length[j], x < y)

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Order of the strings within groups of consecutive rows (group_start and group_size of each row)."""
        order = np.arange(len(start))
        width = 1
        while True:
            rows = np.flatnonzero(size > width)
            if not len(rows):
                return order
            s, n = start[rows], size[rows]
            run = (rows - s) // width
            first = s + (run ^ 1) * width
            other_start, other_end = np.minimum(first, s + n), np.minimum(first + width, s + n)
            me, right = order[rows], (run & 1) == 1
            low, high = other_start.copy(), other_end.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                other, mine, is_right = order[mid], me[open_], right[open_]
                # Equal strings of the left run stay before those of the right.
                before = np.where(is_right, ~self.less(mine, other), self.less(other, mine))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            merged = order.copy()
            merged[s + (run & ~1) * width + (rows - s - run * width) + (low - other_start)] = me
            order, width = merged, 2 * width

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common beginning of each string in sorted order with the one before it (-1 at a group's start)."""
        out = np.full(len(order), -1, np.int64)
        if len(order) > 1:
            a, b = order[:-1], order[1:]
            out[1:] = np.where(group[a] == group[b], self.common(a, b), -1)
        return out


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix and lengths of strings of at most ``width`` bytes."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint8)
    if len(strings):
        flat = np.frombuffer(b"".join(strings), np.uint8)
        out[np.arange(width)[None, :] < length[:, None]] = flat
    return out, length
