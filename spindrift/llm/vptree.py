"""Vantage-point trees over Hamming space.

A pair of 64-bit fingerprints at distance r has halves of which one differs by
r // 2 at most, so each half is searched with that radius and hits are checked
on all bits.  Half the radius prunes far better: the chance that a vantage
point's boundary falls within the radius is what each level of a tree costs.
"""

from __future__ import annotations

import numpy as np

#: A shard's points are compared directly from so many on.
LEAF = 128
#: Queries compared at once, which bounds the matrix of distances.
QUERIES = 16_384


def halves(prints: np.ndarray, half: int) -> np.ndarray:
    return (prints >> np.uint64(32 * half)).astype(np.uint32)


class Shards:
    """The upper levels of a tree, fitted on a sample: its leaves are the shards.

    The sample decides how even the shards are, never which pairs are found.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        self._grow(sample, depth)

    def _grow(self, own: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if depth and len(own) >= 2:
            vantage = own[len(own) // 2]
            d = np.bitwise_count(own ^ vantage)
            mu = int(np.median(d))
            near, far = own[d <= mu], own[d > mu]
            if len(near) and len(far):
                self.nodes[at] = (vantage, mu, self._grow(near, depth - 1), self._grow(far, depth - 1))
                return at
        self.nodes[at] = (self.leaves,)
        self.leaves += 1
        return at

    def route(self, values: np.ndarray, radius: int):
        """(leaf, places of the values at home there, places of those whose ball reaches over)."""
        todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            at, own, home = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                yield node[0], own[home], own[~home]
                continue
            vantage, mu, near, far = node
            d = np.bitwise_count(values[own] ^ vantage).astype(np.int16)
            inside = d <= mu
            to = d - radius <= mu
            todo.append((near, own[to], (home & inside)[to]))
            to = d + radius > mu
            todo.append((far, own[to], (home & ~inside)[to]))


class Groups:
    """Union of places; roots are the smallest place of a group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def link(prints: np.ndarray, n_home: int, half: int, bits: int) -> np.ndarray:
    """Groups ``prints`` by links of at most ``bits`` differing bits, found between the first ``n_home`` and all.

    Returns each print's root, a place in ``prints``.  The points are split
    around vantage points while queries follow every side that their ball
    reaches; what is left at a leaf is compared directly.
    """
    groups, own, radius = Groups(len(prints)), halves(prints, half), bits // 2
    todo = [(np.arange(n_home), np.arange(len(prints)))]
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        split = len(points) > LEAF
        if split:
            vantage = own[points[len(points) // 2]]
            d = np.bitwise_count(own[points] ^ vantage).astype(np.int16)
            mu = int(np.median(d))
            if mu == d.max():
                mu -= 1
            split = mu >= d.min()
        if split:
            q = np.bitwise_count(own[queries] ^ vantage).astype(np.int16)
            todo.append((points[d <= mu], queries[q - radius <= mu]))
            todo.append((points[d > mu], queries[q + radius > mu]))
            continue
        for i in range(0, len(points), LEAF):
            some = points[i : i + LEAF]
            for j in range(0, len(queries), QUERIES):
                asked = queries[j : j + QUERIES]
                hit, to = np.nonzero(np.bitwise_count(prints[asked][:, None] ^ prints[some][None, :]) <= bits)
                a, b = asked[hit], some[to]
                away = a != b
                if away.any():
                    groups.join(a[away], b[away])
    return groups.root
