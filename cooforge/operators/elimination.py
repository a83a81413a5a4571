"""Orderings, elimination trees and patterns of the factor over graphs in compressed rows.

A graph is (ptr, idx): the neighbours of v are idx[ptr[v]:ptr[v + 1]], ascending. The kernels are sequential by nature,
but work on whole arrays wherever vertices do not depend on each other and step through the rest, so that time grows
with the edges and memory is a few arrays of their length, without an object for each vertex.
"""

from __future__ import annotations

import heapq

import numpy as np

Graph = tuple[np.ndarray, np.ndarray]
#: Under so many vertices at once single steps are faster than arrays.
FEW = 64


def compressed_rows(n: int, key: np.ndarray) -> Graph:
    """The graph of edges i * n + j, from 0; sorts ``key`` in place."""
    key.sort()
    ptr = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(key // n, minlength=n), out=ptr[1:])
    key %= n
    return ptr, key


def owners(ptr: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def renumbered(graph: Graph, order: np.ndarray) -> Graph:
    ptr, idx = graph
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key = np.repeat(place, np.diff(ptr))
    key *= len(order)
    key += place[idx]
    return compressed_rows(len(order), key)


def reverse_cuthill_mckee(graph: Graph) -> np.ndarray:
    """Vertices in elimination order: breadth first, neighbours by degree and index, reversed."""
    ptr, idx = graph
    n, degree = len(ptr) - 1, np.diff(ptr)
    by = np.argsort(degree, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    near = np.repeat(np.arange(n), degree)
    near *= n
    near += rank[idx]
    near.sort()
    near %= max(n, 1)
    near = by[near]
    del rank
    seen, order = np.zeros(n, bool), np.empty(n, np.int64)
    done = 0
    for root in by:
        if seen[root]:
            continue
        seen[root], order[done] = True, root
        front, done = order[done : done + 1], done + 1
        while len(front):
            if len(front) < FEW and degree[front].sum() < FEW:
                fresh = []
                for v in front.tolist():
                    for u in near[ptr[v] : ptr[v + 1]].tolist():
                        if not seen[u]:
                            seen[u] = True
                            fresh.append(u)
                fresh = np.array(fresh, np.int64)
            else:  # a whole layer, each vertex where it comes first
                count = degree[front]
                at = np.arange(count.sum()) + np.repeat(ptr[front] - np.cumsum(count) + count, count)
                fresh = near[at]
                fresh = fresh[~seen[fresh]]
                fresh = fresh[np.sort(np.unique(fresh, return_index=True)[1])]
                seen[fresh] = True
            order[done : done + len(fresh)] = fresh
            front, done = fresh, done + len(fresh)
    return order[::-1].copy()


def minimum_degree(graph: Graph) -> np.ndarray:
    """Vertices in elimination order by least degree, smaller index first.

    Vertices of one neighbour at most go first in any such order. They need a degree and the sum (xor) of the
    neighbours each; what they leave, where all have two neighbours or more, takes the quotient graph.
    """
    ptr, idx = graph
    n, row = len(ptr) - 1, owners(ptr)
    degree, other = np.diff(ptr), np.zeros(n, np.int64)
    np.bitwise_xor.at(other, row, idx)
    start = np.flatnonzero(degree <= 1)
    start = start[np.argsort(degree[start], kind="stable")].tolist()
    degree, other, order, late, at = degree.tolist(), other.tolist(), [], [], 0
    while at < len(start) or late:
        if late and (at == len(start) or late[0] < degree[start[at]] * n + start[at]):
            d, v = divmod(heapq.heappop(late), n)
            if degree[v] != d:
                continue
        else:
            v, at = start[at], at + 1
            if degree[v] < 0:
                continue
            if degree[v] == 0 and late and late[0] < v:  # lost its neighbour meanwhile
                heapq.heappush(late, v)
                continue
        if degree[v]:
            u = other[v]
            degree[u] -= 1
            other[u] ^= v
            if degree[u] <= 1:
                heapq.heappush(late, degree[u] * n + u)
        degree[v] = -1
        order.append(v)
    left = np.flatnonzero(np.array(degree) >= 0)
    if not len(left):
        return np.array(order, np.int64)
    place = np.full(n, -1, np.int64)
    place[left] = np.arange(len(left))
    inner = (place[row] >= 0) & (place[idx] >= 0)
    core = compressed_rows(len(left), place[row[inner]] * len(left) + place[idx[inner]])
    return np.concatenate([np.array(order, np.int64), left[_quotient_order(core)]])


def _quotient_order(graph: Graph) -> np.ndarray:
    """Least degree in the quotient graph.

    The queue holds lower bounds: an elimination takes one neighbour at most and brings at least its own reach. A degree
    is counted only when its bound comes first, so a hub is not counted for each of its neighbours. Elements of the
    same members are kept once.
    """
    ptr, idx = graph
    n = len(ptr) - 1
    variables = [set(idx[ptr[v] : ptr[v + 1]].tolist()) for v in range(n)]
    cliques: list[set[int]] = [set() for _ in range(n)]  # eliminated neighbours
    members: dict[int, frozenset[int]] = {}
    known: set[frozenset[int]] = set()
    bound, counted, order = [len(x) for x in variables], [True] * n, []
    heap = sorted(d * n + v for v, d in enumerate(bound))
    while heap:
        d, v = divmod(heapq.heappop(heap), n)
        if bound[v] != d:
            continue
        reach = variables[v].union(*[members[c] for c in cliques[v]])
        reach.discard(v)
        if not counted[v]:
            counted[v] = True
            if len(reach) > d:
                bound[v] = len(reach)
                heapq.heappush(heap, bound[v] * n + v)
                continue
        bound[v] = -1
        order.append(v)
        gone = cliques[v]
        for c in gone:
            known.discard(members.pop(c))
        element = frozenset(reach)
        fresh = len(element) > 1 and element not in known
        if fresh:
            members[v] = element
            known.add(element)
        for u in reach:
            variables[u] -= reach
            variables[u].discard(v)
            cliques[u] -= gone
            if fresh:
                cliques[u].add(v)
            bound[u], counted[u] = max(bound[u] - 1, len(reach) - 1), False
            heapq.heappush(heap, bound[u] * n + u)
        variables[v] = cliques[v] = None
    return np.array(order, np.int64)


def elimination_parents(graph: Graph) -> np.ndarray:
    """Parent of each column of a graph in elimination order; -1 at roots."""
    ptr, idx = graph
    n = len(ptr) - 1
    row = owners(ptr)
    below = idx < row
    k, r = row[below], idx[below]
    parent = np.full(n, -1, np.int64)
    while len(r):  # columns without others before them and one after them bring nothing to that one
        alone = (np.bincount(r, minlength=n)[r] == 1) & (np.bincount(k, minlength=n)[r] == 0)
        if alone.sum() * 8 < len(r):
            break
        parent[r[alone]] = k[alone]
        k, r = k[~alone], r[~alone]
    if len(r):
        up, ancestor = parent.tolist(), [-1] * n
        for k, r in zip(k.tolist(), r.tolist()):
            while r != -1 and r < k:
                above = ancestor[r]
                ancestor[r] = k
                if above == -1:
                    up[r] = k
                r = above
        parent = np.array(up, np.int64)
    return parent


def upward(parent: np.ndarray, value: np.ndarray, fold: np.ufunc, step: int = 0) -> np.ndarray:
    """``value`` of each parent folded with those of its children plus ``step``, from the leaves up; parents have larger numbers."""
    n = len(parent)
    left = np.bincount(parent[parent >= 0], minlength=n)
    done, ready = np.zeros(n, bool), np.flatnonzero(left == 0)
    while len(ready) >= FEW:
        done[ready] = True
        ready = ready[parent[ready] >= 0]
        up = parent[ready]
        fold.at(value, up, value[ready] + step)
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        ready = up[left[up] == 0]
    for v in np.flatnonzero(~done & (parent >= 0)):
        value[parent[v]] = fold(value[parent[v]], value[v] + step)
    return value


def subtree_sizes(parent: np.ndarray) -> np.ndarray:
    """For parents with larger numbers than their children."""
    return upward(parent, np.ones(len(parent), np.int64), np.add)


def postorder(parent: np.ndarray) -> np.ndarray:
    """Columns in an order where each subtree is contiguous and children come first, by number."""
    size, by = subtree_sizes(parent), np.argsort(parent, kind="stable")
    before = np.cumsum(size[by]) - size[by]
    head = np.append(True, parent[by][1:] != parent[by][:-1])[: len(by)]
    start = np.empty(len(parent), np.int64)
    start[by] = before - before[head][np.cumsum(head) - 1]  # among siblings
    up = parent.copy()
    live = np.flatnonzero(up >= 0)
    while len(live):  # sums along the path to the root, by doubling
        above = up[live]
        more, up[live] = start[above], up[above]
        start[live] += more
        live = live[up[live] >= 0]
    order = np.empty(len(parent), np.int64)
    order[start + size - 1] = np.arange(len(parent))
    return order


def column_patterns(graph: Graph, parent: np.ndarray) -> Graph:
    """Rows below the diagonal of each column of the exact factor, in compressed columns: own rows and those of the children."""
    ptr, idx = graph
    n, row = len(ptr) - 1, owners(ptr)
    after = idx > row
    count, own = np.bincount(row[after], minlength=n), idx[after]
    del row, after
    first = np.cumsum(count) - count
    # a column of one row brings nothing to its parent; what lies above one of more rows takes steps
    several = count >= 2
    taking = np.zeros(n, bool)
    up = np.unique(parent[several])
    while len(up) >= FEW:
        up = up[up >= 0]
        up = up[~taking[up]]
        taking[up] = True
        up = np.unique(parent[up])
    for v in up.tolist():
        while v >= 0 and not taking[v]:
            taking[v] = True
            v = int(parent[v])
    pending: dict[int, list[np.ndarray]] = {}
    for v in np.flatnonzero(several & ~taking & (parent >= 0)).tolist():
        pending.setdefault(int(parent[v]), []).append(own[first[v] : first[v] + count[v]])
    found, size = {}, count.copy()
    for v in np.flatnonzero(taking).tolist():
        rows = np.unique(np.concatenate([own[first[v] : first[v] + count[v]], *pending.pop(v, [])]))
        found[v] = rows = rows[rows > v]
        size[v] = len(rows)
        if len(rows) > 1:
            pending.setdefault(int(parent[v]), []).append(rows)
    start = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=start[1:])
    out = np.empty(start[-1], np.int64)
    out[np.repeat(~taking, size)] = own[np.repeat(~taking, count)]
    for v, rows in found.items():
        out[start[v] : start[v + 1]] = rows
    return start, out


def supernodes(rows: np.ndarray, parent: np.ndarray, widest: int = 120) -> np.ndarray:
    """First column of each supernode: runs of columns where each has the one after as parent and one row more, cut at ``widest``."""
    at = np.arange(len(parent))
    joined = np.zeros(len(parent), bool)
    joined[1:] = (parent[:-1] == at[1:]) & (rows[:-1] == rows[1:] + 1)
    run = np.maximum.accumulate(np.where(joined, 0, at))
    return np.flatnonzero((at - run) % widest == 0)


def amalgamate(firsts: np.ndarray, patterns: Graph, parent: np.ndarray, fill: float, widest: int = 120) -> np.ndarray:
    """Merge a supernode into the next one, its parent, while added zeros stay under ``fill`` of the factor's entries."""
    n, (start, rows) = len(parent), patterns
    ends = np.append(firsts[1:], n) if len(firsts) else firsts
    budget = fill * (len(rows) + n)
    merged = []
    for first, end in zip(firsts.tolist(), ends.tolist()):
        below = set(rows[start[end - 1] : start[end]].tolist())
        while merged:
            f0, e0, b0 = merged[-1]
            if parent[e0 - 1] < first or parent[e0 - 1] >= end or end - f0 > widest:
                break
            zeros = (e0 - f0) * (len(set(range(first, end)) | below) - len(b0))
            if zeros > budget:
                break
            budget -= zeros
            merged.pop()
            first = f0
        merged.append([first, end, below])
    return np.array([b[0] for b in merged], np.int64)


def merge_small_subtrees(firsts: np.ndarray, parent: np.ndarray, small: int) -> np.ndarray:
    """First columns of blocks where each largest subtree of at most ``small`` columns (in postorder) is in one block.

    Neighbours under one parent share a block while that has at most ``small`` columns, dealt from the last.
    """
    n, size = len(parent), subtree_sizes(parent)
    starts = np.zeros(n + 1, bool)
    starts[firsts] = True
    root = parent < 0
    tops = np.flatnonzero((size <= small) & (root | (size[np.where(root, 0, parent)] > small)))
    if not len(tops):
        return np.flatnonzero(starts[:-1])
    lows = tops - size[tops] + 1
    starts[:-1][size <= small] = False  # all of these lie in one of the subtrees
    joined = np.append(False, (tops[:-1] + 1 == lows[1:]) & (parent[tops[:-1]] == parent[tops[1:]]))
    left = np.maximum.accumulate(np.where(joined, 0, np.arange(len(tops))))  # the run's leftmost
    at = len(tops) - 1
    while at >= 0:
        end = tops[at] + 1
        low = max(int(np.searchsorted(lows, end - small)), int(left[at]))
        starts[[lows[low], end]] = True
        at = low - 1
    return np.flatnonzero(starts[:-1])


def block_levels(firsts: np.ndarray, block: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Level of each block: 0 without blocks under it, else one more than the highest of those."""
    up = parent[np.append(firsts[1:], len(parent)) - 1] if len(firsts) else firsts
    return upward(np.where(up >= 0, block[np.where(up >= 0, up, 0)], -1), np.zeros(len(firsts), np.int64), np.maximum, 1)
