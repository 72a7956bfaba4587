"""BK-trees over 64-bit fingerprints, built and searched a level at a time in numpy.

A tree's node holds a fingerprint; its children are keyed by their integer Hamming distance to it. A
search with radius r that stands at distance d from a node follows only the edges d-r .. d+r. A shard
holds a forest: one tree for each of its keys.
"""

from __future__ import annotations

from array import array

import numpy as np

#: All edges shorter than the index, as bits.
_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
#: Pairs of query and node looked at in one step; bounds the memory of a search.
FRONTIER = 1 << 18


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of each number in the half-open ranges."""
    size = high - low
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]


class Forest:
    """Trees over ``prints`` (uint64), one for each value of ``keys``; equal prints of a key hang together
    by an edge of length 0. ``order`` lists the nodes grouped by parent and sorted by edge; a node's children
    are there from ``start`` to ``end``, and ``edges`` has a bit for each edge below 64 that it has."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        n = len(prints)
        self.prints = prints
        _, first, tree = np.unique(keys, return_index=True, return_inverse=True)
        self.root = first[tree]
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):
            far = np.bitwise_count(prints[waiting] ^ prints[at]).astype(np.int64)
            _, first, group = np.unique(at * 65 + far, return_index=True, return_inverse=True)
            child = waiting[first]  # the first to arrive becomes the child on that edge
            parent[child], edge[child] = at[first], far[first]
            below = child[group]
            rest = below != waiting
            waiting, at = waiting[rest], below[rest]
        self.order = np.lexsort((edge, parent))
        size = np.bincount(parent[parent >= 0], minlength=n)
        self.end = np.cumsum(size) + n - int(size.sum())  # the roots come first
        self.start = self.end - size
        self.edges = np.zeros(n, np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            bits = np.where(edge < 64, np.uint64(1) << np.minimum(edge, 63).astype(np.uint64), np.uint64(0))
            self.edges[some] = np.bitwise_or.reduceat(bits[self.order], self.start[some])

    def neighbours(self, radius: int):
        """Yields arrays ``(i, j)``, j before i, of pairs under the same key within the radius."""
        n = len(self.prints)
        step = 4096
        for begin in range(0, n, step):
            stack = [(np.arange(begin, min(n, begin + step)), self.root[begin : begin + step])]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                far = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                hit = (far <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                edges, start = self.edges[node], self.start[node]
                low = start + np.bitwise_count(edges & _BELOW[np.maximum(far - radius, 0)])
                high = np.where(far + radius >= 64, self.end[node], start + np.bitwise_count(edges & _BELOW[np.minimum(far + radius + 1, 64)]))
                owner, place = _expand(low, high)
                if len(owner):
                    stack.append((query[owner], self.order[place]))


class Union:
    """Disjoint sets over 0 .. n-1; the smallest member names a set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            if not (open_ := x != y).any():
                return
            np.minimum.at(self.label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


class Sets:
    """Disjoint sets over 0 .. n-1, joined one pair at a time."""

    def __init__(self, n: int):
        self.up = array("i", range(n))

    def copy(self) -> Sets:
        out = Sets(0)
        out.up = self.up[:]
        return out

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart; the smaller root names the set."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def spanning_links(keys: np.ndarray, prints: np.ndarray, radius: int, names: np.ndarray | None = None, more: np.ndarray | None = None, whole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same prints as all pairs within the radius under a common key do: one for each
    print that isn't the first of its set, so never more than there are prints.

    With ``more``, further 64 bits of each print, a pair must also be within ``whole`` over all bits.
    ``names`` are returned in place of the prints."""
    names = prints if names is None else names
    _, tree, size = np.unique(keys, return_inverse=True, return_counts=True)
    shared = size[tree] > 1
    keys, prints, names = keys[shared], prints[shared], names[shared]
    more = None if more is None else more[shared]
    if not len(prints):
        return names, names
    sets = Union(len(prints))
    for i, j in Forest(keys, prints).neighbours(radius):
        if more is not None:
            near = np.bitwise_count(prints[i] ^ prints[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j]) <= whole
            i, j = i[near], j[near]
        sets.add(i, j)
    tied = np.flatnonzero(sets.label != np.arange(len(prints)))
    return names[tied], names[sets.label[tied]]
