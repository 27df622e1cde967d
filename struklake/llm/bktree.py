"""BK-trees over 64-bit codes, many trees at a time, in numpy.

Rows come as (shard, code). The first code of a shard is its tree's root; children are keyed by
their Hamming distance to the parent, and a second code at the same distance goes below the
child. A search follows only edges whose distance is within the radius of the query's distance
to the node. All trees of a batch are built and searched level by level in arrays.
"""

from __future__ import annotations

import numpy as np

#: Queries are cut so that a search front holds about this many (query, node) pairs.
FRONT = 2_000_000
#: Edge keys are parent * STRIDE + distance.
STRIDE = 128


def build(shard: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root of every row's tree, and the edges as sorted keys with their child rows."""
    n = len(code)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
    root = np.repeat(starts, np.diff(np.r_[starts, n]))
    keys, children = [], []
    rest = np.setdiff1d(np.arange(n), starts, assume_unique=True)
    parent = root[rest]
    while len(rest):
        edge = parent * STRIDE + np.bitwise_count(code[rest] ^ code[parent])
        key, first = np.unique(edge, return_index=True)
        keys.append(key)
        children.append(rest[first])
        below = rest[first][np.searchsorted(key, edge)]
        stay = below != rest
        rest, parent = rest[stay], below[stay]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys, kind="stable")
    return root, keys[order], children[order]


def links(shard: np.ndarray, code: np.ndarray, radius: int):
    """Yield (row, earlier row, distance) arrays of all pairs of a shard within the radius."""
    root, keys, children = build(shard, code)
    size = np.bincount(root, minlength=len(code))[root]
    alone = size < 2
    todo = np.flatnonzero(~alone)
    at = 0
    load = np.cumsum(size[todo])
    while at < len(todo):
        stop = max(at + 1, np.searchsorted(load, (load[at - 1] if at else 0) + FRONT, "right"))
        query = todo[at:stop]
        node = root[query]
        at = stop
        while len(query):
            far = np.bitwise_count(code[query] ^ code[node]).astype(np.int64)
            near = (far <= radius) & (node < query)
            if near.any():
                yield query[near], node[near], far[near]
            low = np.searchsorted(keys, node * STRIDE + np.maximum(far - radius, 0))
            high = np.searchsorted(keys, node * STRIDE + far + radius, "right")
            width = high - low
            query = np.repeat(query, width)
            step = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
            node = children[np.repeat(low, width) + step]


def spanning(shard: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within the radius that connect whatever such pairs connect: a spanning forest."""
    label = np.arange(len(code))
    left, right = [], []
    for a, b, _ in links(shard, code, radius):
        a_root, b_root = label[a], label[b]
        apart = a_root != b_root
        a, b, a_root, b_root = a[apart], b[apart], a_root[apart], b_root[apart]
        _, first = np.unique(np.maximum(a_root, b_root) * len(code) + np.minimum(a_root, b_root), return_index=True)
        for i in first:
            x, y = int(a_root[i]), int(b_root[i])
            while label[x] != x:
                x = int(label[x])
            while label[y] != y:
                y = int(label[y])
            if x != y:
                label[max(x, y)] = min(x, y)
                left.append(a[i])
                right.append(b[i])
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label = flat
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
