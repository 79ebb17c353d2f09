"""Compressed rows of a graph of bounded size, for kernels that walk it vertex by vertex."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Edges that a broadcast graph may have; its arrays then take 8 bytes an edge and direction. Larger graphs are
#: traversed by joins.
LIMIT = 50_000_000
#: Edges that are looked at together, for many sources at once.
CHUNK = 1 << 18


class Csr:
    """Vertices are 0..n-1 in the order of ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        self.n = n = len(self.ids)
        key = np.unique(flat[: len(src)].astype(np.int64) * n + flat[len(src) :])  # a repeated edge is no further path
        self.m, a, b = len(key), key // max(n, 1), key % max(n, 1)
        self.out_at, self.out_to = self._rows(a, b)
        order = np.argsort(b, kind="stable")
        self.in_at, self.in_to = self._rows(b[order], a[order])

    def _rows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of edges sorted by a."""
        at = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=self.n))))
        return at.astype(np.int32 if len(b) < 2**31 else np.int64), b.astype(np.int32)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The vertices of ids, -1 where there is none."""
        at = np.searchsorted(self.ids, ids)
        at[at == self.n] = 0
        return np.where(self.ids[at] == ids, at, -1) if self.n else np.full(len(ids), -1)

    def expand(self, at: np.ndarray, to: np.ndarray, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges that leave the frontier: their starts and ends."""
        n = at[frontier + 1] - at[frontier]
        place = np.repeat(at[frontier] - np.cumsum(n, dtype=at.dtype) + n, n)
        place += np.arange(len(place), dtype=at.dtype)
        return np.repeat(frontier.astype(np.int32), n), to[place]

    def distances(self, source: int, within: np.ndarray | None = None, backward: bool = False) -> tuple[np.ndarray, int]:
        """Distances from source (-1 beyond reach), in its own class of within alone, and the largest of them."""
        at, to = (self.in_at, self.in_to) if backward else (self.out_at, self.out_to)
        dist = np.full(self.n, -1)
        dist[source], frontier, depth = 0, np.array([source]), 0
        while True:
            _, ends = self.expand(at, to, frontier)
            ends = np.unique(ends[dist[ends] < 0])
            if within is not None:
                ends = ends[within[ends] == within[source]]
            if not len(ends):
                return dist, depth
            depth += 1
            dist[ends], frontier = depth, ends

    def paths(self, source: int, work: tuple[np.ndarray, np.ndarray] | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Distances, numbers of shortest paths, levels, and the shortest-path edges into each level after the first.

        A level is found along the edges that leave the last one, or where those are fewer along the edges that enter what
        is not reached yet. work holds -1 and 0 everywhere; of it only what is in the levels is changed.
        """
        dist, sigma = work or (np.full(self.n, -1, np.int32), np.zeros(self.n))
        dist[source], sigma[source] = 0, 1.0
        levels, links, depth, last = [np.array([source])], [], 0, None
        left = self.m - int(self.in_at[source + 1] - self.in_at[source])
        while True:
            if depth == most:
                return dist, sigma, levels, links
            border = levels[-1]
            out = int((self.out_at[border + 1] - self.out_at[border]).sum()) if left else 0
            if left < out:
                b, a = self.expand(self.in_at, self.in_to, np.flatnonzero(dist < 0))
                found = dist[a] == depth
                a, b = a[found], b[found]
                ends = b[np.flatnonzero(np.diff(b, prepend=-1))]
            else:
                a, b = self.expand(self.out_at, self.out_to, border[:0] if not left else border)
                new = dist[b] < 0
                a, b = a[new], b[new]
                last = np.empty(self.n, np.int32) if last is None else last
                place = np.arange(len(b), dtype=np.int32)
                last[b] = place
                ends = b[last[b] == place]  # each end once
            if not len(b):
                return dist, sigma, levels, links
            depth += 1
            self._add(sigma, b, sigma[a])
            dist[ends] = depth
            left -= int((self.in_at[ends + 1] - self.in_at[ends]).sum())
            levels.append(ends), links.append((a, b))

    def _add(self, to: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
        if 8 * len(at) > self.n:
            to += np.bincount(at, what, self.n)
        else:
            np.add.at(to, at, what)

    def dependency(self, source: int, endpoints: bool = False) -> np.ndarray:
        """What source adds to each vertex's number of shortest paths passing through it."""
        _, sigma, _, links = self.paths(source)
        dep = np.zeros(self.n)
        for a, b in reversed(links):
            self._add(dep, a, sigma[a] * ((1 + dep) / np.where(sigma > 0, sigma, 1.0))[b] if 2 * len(b) > self.n else sigma[a] * (1 + dep[b]) / sigma[b])
        dep[source] = 0
        if endpoints:
            reached = sigma > 0
            dep[reached] += 1
            dep[source] += reached.sum() - 2
        return dep

    def reached(self, sources: np.ndarray) -> np.ndarray:
        """How many vertices are at each distance (rows, from 0) from each of some distinct sources (columns).

        All sources are followed at once, a bit each: a vertex is reached by what has just reached those before it.
        """
        width = -(-len(sources) // 64)
        bit = np.arange(len(sources))
        seen = np.zeros((self.n, width), np.uint64)
        seen[sources, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        full = np.bitwise_or.reduce(seen, axis=0)
        border, counts = seen.copy(), [np.ones(len(sources), np.int64)]
        fed, outs = np.diff(self.in_at), np.diff(self.out_at)
        rest = np.flatnonzero(fed)
        while True:
            rest = rest[(seen[rest] != full).any(1)]
            near, active = rest, np.flatnonzero(border.any(1))
            if 4 * outs[active].sum() < fed[rest].sum():
                met = np.zeros(self.n, bool)
                met[self.expand(self.out_at, self.out_to, active)[1]] = True
                near = rest[met[rest]]
            new, c = np.zeros_like(seen), np.zeros(64 * width, np.int64)
            ends = np.cumsum(fed[near])
            cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK), "right").tolist() if len(ends) else []
            for some in np.split(near, sorted({0, *cuts})[1:]) if len(near) else []:
                size = fed[some]
                first = np.cumsum(size) - size
                _, before = self.expand(self.in_at, self.in_to, some)
                new[some] = np.bitwise_or.reduceat(border[before], first, axis=0) & ~seen[some]
                c += np.unpackbits(new[some].astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            if not c.any():
                return np.array(counts)
            seen |= new
            border = new
            counts.append(c[: len(sources)])

    def eccentricity(self, source: int, of: np.ndarray, dist: np.ndarray, backward: bool = False) -> int:
        """The largest distance from source within its component; dist holds -1 everywhere, and does so again after."""
        at, to = (self.in_at, self.in_to) if backward else (self.out_at, self.out_to)
        border, depth, touched = np.array([source]), 0, [np.array([source])]
        dist[source] = 0
        while True:
            size = at[border + 1] - at[border]
            ends = np.cumsum(size)
            b = to[np.repeat(at[border] - ends + size, size) + np.arange(ends[-1])]
            b = np.unique(b[(dist[b] < 0) & (of[b] == of[source])])
            if not len(b):
                break
            depth += 1
            dist[b] = depth
            touched.append(b)
            border = b
        dist[np.concatenate(touched)] = -1
        return depth

    def strong_components(self) -> tuple[np.ndarray, list[int]]:
        """Component numbers, sinks of the condensation first, found without recursion; and their list."""
        index, low, of = [-1] * self.n, [0] * self.n, [-1] * self.n
        at, to = self.out_at.tolist(), self.out_to.tolist()
        clock = count = 0
        held: list[int] = []
        for root in range(self.n):
            if index[root] >= 0:
                continue
            calls = [(root, at[root])]
            index[root] = low[root] = clock
            clock += 1
            held.append(root)
            while calls:
                v, e = calls.pop()
                while e < at[v + 1]:
                    w = to[e]
                    e += 1
                    if index[w] < 0:
                        index[w] = low[w] = clock
                        clock += 1
                        held.append(w)
                        calls.append((v, e))
                        calls.append((w, at[w]))
                        break
                    if of[w] < 0:
                        low[v] = min(low[v], index[w])
                else:
                    if low[v] == index[v]:
                        while True:
                            w = held.pop()
                            of[w] = count
                            if w == v:
                                break
                        count += 1
                    if calls:
                        p = calls[-1][0]
                        low[p] = min(low[p], low[v])
        return np.array(of, np.int64), list(range(count))


def collected(edges: DataFrame, limit: int = LIMIT) -> Csr:
    """The graph of edges, after its size is checked."""
    held = edges.select("src", "dst").persist()  # counted, then read
    try:
        if (m := held.count()) > limit:
            raise ValueError(f"{m} edges are more than a broadcast graph may have ({limit}); use the operators made of joins")
        table = held.toArrow()
    finally:
        held.unpersist()
    return Csr(table.column(0).to_numpy(), table.column(1).to_numpy())
