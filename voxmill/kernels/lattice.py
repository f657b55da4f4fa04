"""Adjacency, shortest paths and forests on the voxels of one component."""

from __future__ import annotations

import heapq
import itertools

import numpy as np

OFFSETS = np.array([d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)])


def sort_rows(v: np.ndarray) -> np.ndarray:
    return np.unique(np.asarray(v, np.int64).reshape(-1, 3), axis=0)


class Lookup:
    """Rows of sorted distinct voxels by coordinate."""

    def __init__(self, v: np.ndarray):
        self.lo = v.min(0) - 2 if len(v) else np.zeros(3, np.int64)
        self.dims = (v.max(0) - self.lo + 3) if len(v) else np.ones(3, np.int64)
        self.keys = self._key(v)

    def _key(self, v):
        d = v - self.lo
        return (d[..., 0] * self.dims[1] + d[..., 1]) * self.dims[2] + d[..., 2]

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Row of each voxel, or -1."""
        out = np.full(v.shape[:-1], -1, np.int64)
        ok = ((v >= self.lo) & (v < self.lo + self.dims)).all(-1)
        if len(self.keys) and ok.any():
            k = self._key(v[ok])
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[ok] = np.where(self.keys[at] == k, at, -1)
        return out


def neighbour_table(v: np.ndarray) -> np.ndarray:
    """For each of the sorted voxels the rows of its 26 neighbours, -1 where there is none."""
    look = Lookup(v)
    return np.stack([look.rows(v + o) for o in OFFSETS], axis=1) if len(v) else np.zeros((0, 26), np.int64)


def edges_of(table: np.ndarray) -> np.ndarray:
    a, k = np.nonzero(table >= 0)
    b = table[a, k]
    return np.stack([a, b], axis=1)[a < b]


def run_pass(g: np.ndarray, step: float, short: int = 48) -> np.ndarray:
    """Squared distances to the background of one run of consecutive places, given those (g) of the axes before."""
    n = len(g)
    i = np.arange(n)
    out = (step * np.minimum(i + 1, n - i)) ** 2
    finite = np.flatnonzero(np.isfinite(g))
    if not len(finite):
        return out
    if n <= short:
        return np.minimum(out, (g[finite] + (step * (i[:, None] - finite[None, :])) ** 2).min(1))
    # the lower envelope of the parabolas over the run: each is put on and taken off once
    kept: list[int] = []
    begins: list[float] = []  # where each kept one is the least from
    height = (g / step**2).tolist()
    for q in finite.tolist():
        while kept:
            p = kept[-1]
            cut = ((height[q] + q * q) - (height[p] + p * p)) / (2 * (q - p))
            if cut > begins[-1]:
                break
            kept.pop()
            begins.pop()
        begins.append(cut if kept else -np.inf)
        kept.append(q)
    own = np.array(kept)[np.searchsorted(np.array(begins), i, side="right") - 1]
    return np.minimum(out, g[own] + (step * (i - own)) ** 2)


def distances(v: np.ndarray, spacing: np.ndarray) -> np.ndarray:
    """Distance of each of the distinct voxels to the nearest cell outside, axis by axis along runs."""
    g = np.full(len(v), np.inf)
    for axis in range(3):
        p, q = (axis + 1) % 3, (axis + 2) % 3
        order = np.lexsort((v[:, axis], v[:, q], v[:, p]))
        w = v[order]
        new = np.r_[True, (np.diff(w[:, axis]) != 1) | (np.diff(w[:, p]) != 0) | (np.diff(w[:, q]) != 0)] if len(v) else np.zeros(0, bool)
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True):
            g[order[a:b]] = run_pass(g[order[a:b]], spacing[axis])
    return np.sqrt(g)


class Paths:
    """Shortest paths over given edges, whose ends and lengths are held as arrays by node."""

    def __init__(self, points: np.ndarray, pairs: np.ndarray):
        self.n = len(points)
        src, dst = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        order = np.argsort(src, kind="stable")
        src, self.dst = src[order], dst[order]
        self.length = np.linalg.norm(points[src] - points[self.dst], axis=1)
        self.first = np.searchsorted(src, np.arange(self.n + 1))

    def distances(self, sources) -> np.ndarray:
        """Distances from the sources, a wave front at a time.

        A front is all that lies within one shortest edge of the nearest open node. No edge leads from a front into itself, so its
        distances are final, and all its edges are relaxed together.
        """
        dist = np.full(self.n, np.inf)
        open_ = np.unique(np.asarray(sources, np.int64))
        dist[open_] = 0.0
        width = self.length.min() if len(self.length) else 1.0
        while len(open_):
            near = dist[open_] < dist[open_].min() + width
            front, open_ = open_[near], open_[~near]
            times = self.first[front + 1] - self.first[front]
            at = np.repeat(self.first[front] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            to, reach = self.dst[at], np.repeat(dist[front], times) + self.length[at]
            better = reach < dist[to]
            to, reach = to[better], reach[better]
            np.minimum.at(dist, to, reach)
            open_ = np.union1d(open_, to)
        return dist

    def field(self, sources, toll, stop=None):
        """Distances from the sources and predecessors. toll: extra cost of entering a node. stop: end at the first settled node of this set."""
        dist, pred = np.full(self.n, np.inf), np.full(self.n, -1, np.int64)
        heap = [(0.0, int(s)) for s in sources]
        dist[[s for _, s in heap]] = 0.0
        heapq.heapify(heap)
        done, hit = np.zeros(self.n, bool), -1
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if stop is not None and stop[u]:
                hit = u
                break
            own = slice(self.first[u], self.first[u + 1])
            to = self.dst[own]
            reach = d + self.length[own] + toll[to]
            better = reach < dist[to]
            to, reach = to[better], reach[better]
            dist[to], pred[to] = reach, u
            for e, w in zip(reach.tolist(), to.tolist(), strict=True):
                heapq.heappush(heap, (e, w))
        return dist, pred, hit


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least row of each row's component: labels go down along edges and then jump to their label's label, until none changes."""
    label = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while len(a):
        p, q = label[a], label[b]
        new = label.copy()
        # roots alone are hooked, so that rows of one label stay together
        np.minimum.at(new, np.maximum(p, q), np.minimum(p, q))
        while (new[new] != new).any():
            new = new[new]
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def spanning_forest(n: int, pairs: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Kruskal's minimum forest: rows of pairs, ties by row."""
    up, kept = list(range(n)), []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in np.argsort(cost, kind="stable").tolist():
        p, q = find(int(pairs[k, 0])), find(int(pairs[k, 1]))
        if p != q:
            up[p] = q
            kept.append(k)
    return np.sort(np.array(kept, np.int64))
