"""Tries of fingerprints, walked in pairs of nodes."""

from __future__ import annotations

import itertools

import numpy as np


def descend(
    fps: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, errors: np.ndarray, bits: range, budget: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct fingerprints (their places) that the node pairs ``al:ah, bl:bh`` lead to.

    A node is a range of fingerprints that are sorted, and distinct, by ``bits``.  Node pairs go down one bit
    at a time: equal bits keep the error count, different bits add one, and pairs over the budget or with
    an empty node are dropped.
    """
    for bit in bits:
        set_before = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        am = ah - (set_before[ah] - set_before[al])
        bm = bh - (set_before[bh] - set_before[bl])
        own = (al == bl) & (ah == bh)
        spent = errors + 1
        parts = [
            (al, am, bl, bm, errors, None), (am, ah, bm, bh, errors, None),
            (al, am, bm, bh, spent, None), (am, ah, bl, bm, spent, ~own),  # a node with itself crosses once
        ]
        grown = []
        for pl, ph, ql, qh, err, also in parts:
            keep = (ph > pl) & (qh > ql) & (err <= budget)
            # a single fingerprint is not paired with itself
            keep &= ~((pl == ql) & (ph - pl == 1) & (qh - ql == 1))
            if also is not None:
                keep &= also
            grown.append([x[keep] for x in (pl, ph, ql, qh, err)])
        al, ah, bl, bh, errors = (np.concatenate(x) for x in zip(*grown))
        if not len(al):
            break
    return al, bl


def self_joined(leaves: np.ndarray, bits: int, budget: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``x < y`` of places of ``leaves`` of one trie whose lowest ``bits`` bits differ in at most ``budget``.

    ``leaves`` are sorted and distinct; what is above the bits names the trie.  All tries are walked with themselves,
    ``step`` bits at a time (``step`` divides ``bits``): a pair of nodes leads to the pairs of their children that
    differ in no more bits than are left.  For each such difference the other child is looked up, so a level
    costs a few reads a child, where ``descend`` builds all pairs of nodes of every single bit.
    """
    masks = [[sum(1 << k for k in chosen) for chosen in itertools.combinations(range(step), r)] for r in range(budget + 1)]
    nodes = np.unique(leaves >> bits)
    x = y = np.arange(len(nodes))
    errors = np.zeros(len(nodes), np.int8)
    for low in range(bits - step, -1, -step):
        below = leaves >> low
        below = below[np.flatnonzero(np.r_[True, below[1:] != below[:-1]])] if low else leaves
        own = below & ((1 << step) - 1)
        parent = np.searchsorted(nodes, below >> step)
        first = np.searchsorted(parent, np.arange(len(nodes) + 1))
        place = np.full(len(nodes) << step, -1)
        place[(parent << step) | own] = np.arange(len(below))
        grown = []
        for spent in range(budget + 1):
            some = errors == spent
            px, py = x[some], y[some]
            size = first[px + 1] - first[px]
            child = np.arange(size.sum()) + np.repeat(first[px] - np.cumsum(size) + size, size)
            at = np.repeat(py << step, size) | own[child]
            for more in range(budget - spent + 1):
                for mask in masks[more]:
                    other = place[at ^ mask]
                    keep = np.flatnonzero(other >= child)  # nodes are sorted: each pair is met once
                    grown.append((child[keep], other[keep], np.full(len(keep), spent + more, np.int8)))
        x, y, errors = (np.concatenate(column) for column in zip(*grown))
        nodes = below
    apart = x != y
    return x[apart], y[apart]


def trie_links(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of fingerprints within ``budget`` bits, over many trie pairs at once.

    ``keys`` names the trie pair of each fingerprint and ``side`` its trie (0 or 1; where a trie
    is paired with itself all are on side 0).  The pairs are walked by ``descend``.
    """
    order = np.lexsort((fps, side, keys))
    keys, side, fps = keys[order], side[order], fps[order]
    n = len(fps)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], n]
    ones = np.r_[0, np.cumsum(side)]
    middle = last - (ones[last] - ones[first])
    paired = (keys[first] >> depth) != (keys[first] & ((1 << depth) - 1))
    # both sides of a pair of tries, or one trie with itself
    al, ah = first, middle
    bl, bh = np.where(paired, middle, first), last
    top = fps[np.minimum(al, n - 1)] ^ fps[np.minimum(bl, n - 1)]
    errors = np.bitwise_count((top >> np.uint64(64 - depth)) if depth else np.zeros(len(top), np.uint64)).astype(np.int64)
    live = (ah > al) & (bh > bl) & (errors <= budget)
    al, ah, bl, bh, errors = (x[live] for x in (al, ah, bl, bh, errors))
    al, bl = descend(fps, al, ah, bl, bh, errors, range(63 - depth, -1, -1), budget)
    return order[al], order[bl]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches by the links ``u, v``."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[u], root[v])
        np.minimum.at(low, root[v], root[u])
        low = low[root]
        while True:
            jumped = low[low]
            if (jumped == low).all():
                break
            low = jumped
        if (low == root).all():
            return root
        root = low


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component of the links, so that a dense group leaves few rows."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    root = roots(len(nodes), flat[:len(a)], flat[len(a):])
    leaf = root != np.arange(len(nodes))
    return nodes[root[leaf]], nodes[leaf]
