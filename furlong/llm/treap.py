"""A quadtree over a grid of terms and documents, and the joint best-first search of many queries in it.

The grid of a shard has a row for each term, a column for each document and in a cell the impact
of the term on the document, a positive integer. The tree halves both sides at each level; a
node says which of its four quarters hold a point (four bits, row half first) and how much its
greatest impact is below that of its parent. Nodes are in level order, so no pointers are kept:
the children of a node follow from counting bits.

A query is a set of rows with weights. A search state is an aligned range of documents with, for
each row of the query that has a point there, the one node on the row's path down the tree. The
sum of weight times node maximum bounds the score of every document of the range. States are
opened in order of that bound, a few of each query at a time, until none can enter the best k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(16)], dtype=np.int64)
#: How many children a node has before its quarter q, by (bits, q).
_BEFORE = np.array([[bin(b & ((1 << q) - 1)).count("1") for q in range(4)] for b in range(16)], dtype=np.int64)


@dataclass
class Tree:
    """height: levels below the root; best, first and bits of each node, level by level, leaves last."""

    height: int
    best: np.ndarray
    first: np.ndarray
    bits: np.ndarray


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit values at the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def pack(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[int, bytes, bytes, int]:
    """(height, bits, drops, greatest impact) of distinct points; there must be one at least.

    bits has two nodes to a byte. drops has, below the root, the parent's maximum less the node's own.
    """
    side = int(max(rows.max(), columns.max())) + 1
    height = max(1, (side - 1).bit_length())
    key = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(key, kind="stable")
    key, best = key[order], impacts[order].astype(np.int64)
    drops, bits = [], []
    for _ in range(height):
        up = key >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        top = np.maximum.reduceat(best, start)
        drops.append(np.repeat(top, np.diff(np.append(start, len(key)))) - best)
        quarter = np.left_shift(1, (key & np.uint64(3)).astype(np.int64))
        bits.append(np.add.reduceat(quarter, start).astype(np.uint8))
        key, best = up[start], top
    flat = np.concatenate(bits[::-1])
    flat = np.append(flat, np.zeros(len(flat) % 2, dtype=np.uint8))
    nibbles = flat[0::2] | flat[1::2] << 4
    return height, nibbles.tobytes(), np.concatenate(drops[::-1]).astype("<u4").tobytes(), int(best[0])


def unpack(height: int, bits: bytes, drops: bytes, greatest: int) -> Tree:
    drop = np.frombuffer(drops, dtype="<u4").astype(np.int64)
    packed = np.frombuffer(bits, dtype=np.uint8)
    flat = np.empty(2 * len(packed), dtype=np.uint8)
    flat[0::2], flat[1::2] = packed & 15, packed >> 4
    best = np.empty(len(drop) + 1, dtype=np.int64)
    best[0] = greatest
    lo, hi = 0, 1  # the nodes of a level
    for _ in range(height):
        size = _ONES[flat[lo:hi]]
        below = hi + int(size.sum())
        best[hi:below] = np.repeat(best[lo:hi], size) - drop[hi - 1 : below - 1]
        lo, hi = hi, below
    inner = flat[:lo]
    first = 1 + np.cumsum(_ONES[inner]) - _ONES[inner]
    return Tree(height, best, first, inner)


def search(
    tree: Tree,
    query: np.ndarray,
    row: np.ndarray,
    weight: np.ndarray,
    n_queries: int,
    k: int,
    least: np.ndarray,
    keys: np.ndarray,
    opened: int = 128,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, score): each query's k best columns with a score of at least max(1, least).

    query, row and weight name the rows of each query. least is a bound below which a query needs
    nothing more. Equal scores are ordered by keys[column], distinct integers. opened is how many
    states of a query are opened at once; it changes the order of work only.
    """
    floor = np.maximum(least, 1)
    found_q, found_c, found_s = (np.zeros(0, dtype=np.int64) for _ in range(3))
    # states; entries of a state follow each other in (entry_row, entry_weight, entry_node)
    usable = weight > 0
    query, row, weight = query[usable], row[usable], weight[usable]
    order = np.argsort(query, kind="stable")
    query, e_row, e_weight = query[order], row[order], weight[order]
    e_node = np.zeros(len(e_row), dtype=np.int64)
    s_query, s_size = np.unique(query, return_counts=True)
    s_level, s_column = np.zeros_like(s_query), np.zeros_like(s_query)
    s_bound = np.add.reduceat(e_weight * tree.best[0], np.cumsum(s_size) - s_size) if len(s_query) else s_query
    while len(s_query):
        begin = np.cumsum(s_size) - s_size
        hopeful = s_bound >= floor[s_query]
        order = np.lexsort((-s_bound, s_query))
        order = order[hopeful[order]]
        if not len(order):
            break
        q = s_query[order]
        lead = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(order)) - np.repeat(lead, np.diff(np.append(lead, len(order))))
        now, later = order[place < opened], order[place >= opened]

        # open: both halves of the range, each with the entries whose quarter exists
        take = _runs(begin[now], s_size[now])
        state = np.repeat(np.arange(len(now)), s_size[now])
        node, rows, w = e_node[take], e_row[take], e_weight[take]
        half = (rows >> (tree.height - 1 - s_level[now][state])) & 1
        has, first = tree.bits[node], tree.first[node]
        parts = []
        for side in (0, 1):
            quarter = 2 * half + side
            there = np.flatnonzero((has >> quarter.astype(np.uint8)) & 1)
            child = first[there] + _BEFORE[has[there], quarter[there]]
            parts.append((2 * state[there] + side, child, rows[there], w[there]))
        new, child, rows, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(new, kind="stable")
        new, child, rows, w = new[order], child[order], rows[order], w[order]
        lead = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(new)))
        bound = np.add.reduceat(w * tree.best[child], lead) if len(new) else lead
        parent = now[new[lead] // 2]
        n_query, n_level = s_query[parent], s_level[parent] + 1
        n_column = 2 * s_column[parent] + (new[lead] & 1)

        leaf = n_level == tree.height
        if leaf.any():
            good = leaf & (bound >= floor[n_query])
            found_q = np.concatenate([found_q, n_query[good]])
            found_c = np.concatenate([found_c, n_column[good]])
            found_s = np.concatenate([found_s, bound[good]])
            order = np.lexsort((keys[found_c], -found_s, found_q))
            found_q, found_c, found_s = found_q[order], found_c[order], found_s[order]
            lead = np.flatnonzero(np.concatenate([[True], found_q[1:] != found_q[:-1]])) if len(found_q) else lead[:0]
            place = np.arange(len(found_q)) - np.repeat(lead, np.diff(np.append(lead, len(found_q))))
            keep = place < k
            last = place == k - 1
            floor[found_q[last]] = np.maximum(floor[found_q[last]], found_s[last])
            found_q, found_c, found_s = found_q[keep], found_c[keep], found_s[keep]
        stay = ~leaf & (bound >= floor[n_query])
        old = _runs(begin[later], s_size[later])
        in_new = np.repeat(stay, size)
        e_node = np.concatenate([e_node[old], child[in_new]])
        e_row = np.concatenate([e_row[old], rows[in_new]])
        e_weight = np.concatenate([e_weight[old], w[in_new]])
        s_size = np.concatenate([s_size[later], size[stay]])
        s_query = np.concatenate([s_query[later], n_query[stay]])
        s_level = np.concatenate([s_level[later], n_level[stay]])
        s_column = np.concatenate([s_column[later], n_column[stay]])
        s_bound = np.concatenate([s_bound[later], bound[stay]])
    return found_q, found_c, found_s


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same of the next run."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
