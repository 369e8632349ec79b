"""BK-trees over 64-bit fingerprints, many at a time, as numpy arrays.

A BK-tree keeps each child under the integer Hamming distance to its parent.
A search from the root computes the distance d of the query to a node and,
by the triangle inequality, follows only the edges within d - radius and
d + radius. All trees of a batch are grown and searched together, one level
per step.
"""

from __future__ import annotations

import numpy as np

BITS = 64
EDGES = BITS + 1
# (query, node) pairs that a search holds at once.
FRONTIER = 1 << 18


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree for each run of equal values in ``tree`` (sorted); codes are distinct within a tree.

    Node i holds ``codes[i]``; the root of a tree is its first code.
    """

    def __init__(self, codes: np.ndarray, tree: np.ndarray) -> None:
        self.codes = codes
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
        self.tree_ids, self.roots = tree[first], first
        at = first[np.searchsorted(self.tree_ids, tree)] if len(tree) else first
        waiting = np.flatnonzero(at != np.arange(len(codes)))
        edges: list[np.ndarray] = []
        children: list[np.ndarray] = []
        at = at[waiting]
        while len(waiting):
            edge = at * EDGES + hamming(codes[waiting], codes[at])
            # Of those that meet on an edge the first becomes the child there, the rest go down to it.
            taken, chosen, inverse = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(waiting[chosen])
            below = waiting[chosen][inverse]
            rest = below != waiting
            waiting, at = waiting[rest], below[rest]
        all_edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        all_children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(all_edges)
        self.edges, self.children = all_edges[order], all_children[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int):
        """Yield blocks of (query number, node) with a distance of at most ``radius``, each in the query's tree."""
        if not len(self.tree_ids):
            return
        place = np.minimum(np.searchsorted(self.tree_ids, tree), len(self.tree_ids) - 1)
        known = np.flatnonzero(self.tree_ids[place] == tree)
        stack = [(known[i : i + FRONTIER], self.roots[place[known[i : i + FRONTIER]]]) for i in range(0, len(known), FRONTIER)]
        while stack:
            query, node = stack.pop()
            distance = hamming(queries[query], self.codes[node])
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            low = node * EDGES + np.maximum(distance - radius, 0)
            high = node * EDGES + np.minimum(distance + radius, BITS)
            start = np.searchsorted(self.edges, low, "left")
            count = np.searchsorted(self.edges, high, "right") - start
            total = int(count.sum())
            if not total:
                continue
            next_query = np.repeat(query, count)
            offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            next_node = self.children[np.repeat(start, count) + offset]
            stack.extend((next_query[i : i + FRONTIER], next_node[i : i + FRONTIER]) for i in range(0, total, FRONTIER))


def lowest_linked(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest item it is linked to, directly or through others; pairs: blocks of (a, b)."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root
