"""Strongly connected groups of the edges that one task holds."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def _core(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges left when nodes without an edge in or out are taken away, as long as a round takes a tenth of the edges."""
    while True:
        came, left = np.zeros(n, bool), np.zeros(n, bool)
        came[dst], left[src] = True, True
        stay = came[src] & left[dst]
        less, size = int(stay.sum()), len(src)
        src, dst = src[stay], dst[stay]
        if less >= 0.9 * size:
            return src, dst


def strong_groups(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The number of the strongly connected group of each of ``n`` nodes (Tarjan, without recursion): time in proportion to the edges, 4 bytes an edge and 28 a node at most."""
    packed = lambda x: array("i", x.astype(np.int32).tobytes())
    order = np.argsort(src, kind="stable")
    to, at = packed(dst[order]), packed(np.searchsorted(src[order], np.arange(n + 1)))
    del order
    ends, group = at[1:], packed(np.full(n, -1))
    index, low, open_, way, met, groups = packed(np.zeros(n)), packed(np.zeros(n)), array("i"), array("i"), 0, 0
    for root in range(n):
        if index[root]:
            continue
        met += 1
        index[root] = low[root] = met
        open_.append(root)
        way.append(root)
        while way:
            v = way[-1]
            if at[v] < ends[v]:
                w = to[at[v]]
                at[v] += 1
                if not index[w]:
                    met += 1
                    index[w] = low[w] = met
                    open_.append(w)
                    way.append(w)
                elif group[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
            else:
                way.pop()
                if low[v] == index[v]:
                    while True:
                        w = open_.pop()
                        group[w] = groups
                        if w == v:
                            break
                    groups += 1
                if way and low[v] < low[way[-1]]:
                    low[way[-1]] = low[v]
    return np.array(group, np.int64)


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, grp, size`` of the nodes in groups of two or more, of edges ``src, dst`` (all edges of such a group together).

    Nodes are bytes, so they compare as Spark compares strings.
    """
    known: dict[bytes, int] = {}
    ends: tuple[list, list] = ([], [])
    for batch in batches:
        for side, column in zip(ends, batch.columns[:2]):
            coded = column.dictionary_encode()
            ids = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int32)
            side.append(ids[coded.indices.to_numpy()])
    if not known:
        return
    src, dst = _core(*(np.concatenate(x) for x in ends), len(known))
    nodes, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    if not len(nodes):
        return
    group = strong_groups(both[: len(src)], both[len(src) :], len(nodes))
    sizes = np.bincount(group)
    names = list(known)
    rows = [(names[x], g) for x, g in zip(nodes.tolist(), group.tolist()) if sizes[g] > 1]
    greatest: dict[int, bytes] = {}
    for name, g in rows:
        if name > greatest.get(g, b""):
            greatest[g] = name
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in part], pa.binary()), pa.array([greatest[g] for _, g in part], pa.binary()), pa.array([int(sizes[g]) for _, g in part], pa.int64())], ["node", "grp", "size"]
        )


def numbered_groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, g`` of the nodes in groups of two or more, of edges ``a, b`` in order of ``a`` (all edges of such a group together). ``g`` is the greatest number in the group."""
    starts, firsts, ends, size, last = [], [], [], 0, None
    for batch in batches:
        a, b = (x.to_numpy(zero_copy_only=False) for x in batch.columns[:2])
        if not len(a):
            continue
        new = np.flatnonzero(np.concatenate([[last is None or a[0] != last], a[1:] != a[:-1]]))
        starts.append(a[new])
        firsts.append(new + size)
        ends.append(b.copy())  # else the whole batch stays
        size, last = size + len(a), a[-1]
    if not size:
        return
    numbers = np.concatenate(starts)
    dst = np.empty(size, np.int32)
    for i, b in zip(np.cumsum([0, *map(len, ends)]), ends):
        at = np.minimum(np.searchsorted(numbers, b), len(numbers) - 1)
        dst[i : i + len(b)] = np.where(numbers[at] == b, at, -1)  # -1: without an edge out
    del ends
    src = np.repeat(np.arange(len(numbers), dtype=np.int32), np.diff(np.concatenate([*firsts, [size]])))
    src, dst = _core(src[dst >= 0], dst[dst >= 0], len(numbers))
    if not len(src):
        return
    used = np.zeros(len(numbers), bool)
    used[src] = used[dst] = True
    nodes, place = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1
    group = strong_groups(place[src], place[dst], len(nodes))
    numbers, greatest = numbers[nodes], np.zeros(group.max() + 1, np.int64)
    np.maximum.at(greatest, group, numbers)
    kept = np.flatnonzero(np.bincount(group)[group] > 1)
    for i in range(0, len(kept), 100_000):
        part = kept[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[part]), pa.array(greatest[group[part]])], ["i", "g"])
