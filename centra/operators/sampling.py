"""Sampling estimators of betweenness: adaptive path sampling with a guarantee, and three fixed-size estimators.

Sample i of a phase hangs on (seed, phase, i) alone, so results do not depend on partitions or parallelism. Batches are
Spark jobs over a broadcast graph; counts of a batch are pre-aggregated in each task.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions import bounds

from .csr import LIMIT, Csr, collected
from .graph import scale
from .traverse import diameter_bound


def _pair(g: Csr, rng: np.random.Generator) -> tuple[int, int]:
    s = int(rng.integers(g.n))
    return s, (s + 1 + int(rng.integers(g.n - 1))) % g.n


class Workspace:
    """Arrays over all vertices that samples share; a sample clears what it has touched."""

    def __init__(self, n: int):
        self.dist, self.sigma = [np.full(n, -1) for _ in range(2)], [np.zeros(n) for _ in range(2)]

    def clear(self, side: int, touched: list[np.ndarray]) -> None:
        for v in touched:
            self.dist[side][v] = -1


def sample_path(g: Csr, s: int, t: int, rng: np.random.Generator, endpoints: bool = False, work: Workspace | None = None) -> list[int]:
    """The vertices of a shortest path s -> t drawn uniformly from all; none if t is s or out of reach.

    Two balls grow, the one whose border has fewer edges next, until an edge joins them; every such edge of that level
    is drawn with the product of its ends' numbers of paths, and so is each step back from there.
    """
    if s == t:
        return []
    work = work or Workspace(g.n)
    dist, sigma = work.dist, work.sigma
    sides = [(g.out_at, g.out_to), (g.in_at, g.in_to)]
    border, links = [np.array([s]), np.array([t])], [[], []]
    touched = [[border[0]], [border[1]]]
    for k, v in ((0, s), (1, t)):
        dist[k][v], sigma[k][v] = 0, 1.0
    edges = [int(at[v + 1] - at[v]) for (at, _), v in zip(sides, (s, t))]
    path: list[int] = []
    while True:
        k = 0 if edges[0] <= edges[1] else 1
        a, b = g.expand(*sides[k], border[k])
        meets = dist[1 - k][b] >= 0
        if meets.any():
            a, b = a[meets], b[meets]
            weight = np.cumsum(sigma[k][a] * sigma[1 - k][b])
            at = min(int(np.searchsorted(weight, rng.random() * weight[-1], "right")), len(a) - 1)
            for side, v in ((k, int(a[at])), (1 - k, int(b[at]))):
                for x, y in reversed(links[side]):
                    path.append(v)
                    own = x[y == v]
                    w = np.cumsum(sigma[side][own])
                    v = int(own[min(int(np.searchsorted(w, rng.random() * w[-1], "right")), len(own) - 1)])
            if endpoints:
                path += [s, t]
            break
        new = dist[k][b] < 0
        a, b = a[new], b[new]
        if not len(b):
            break
        ends, of = np.unique(b, return_inverse=True)
        sigma[k][ends] = np.bincount(of, sigma[k][a])
        dist[k][ends] = dist[k][a[0]] + 1
        border[k] = ends
        touched[k].append(ends), links[k].append((a, b))
        at, _ = sides[k]
        edges[k] = int((at[ends + 1] - at[ends]).sum())
    for k in (0, 1):
        work.clear(k, touched[k])
    return path


def path_counts(g: Csr, seed: int, phase: int, first: int, last: int, endpoints: bool = False) -> np.ndarray:
    counts, work = np.zeros(g.n), Workspace(g.n)
    for i in range(first, last):
        rng = np.random.default_rng((seed, phase, i))
        counts[sample_path(g, *_pair(g, rng), rng, endpoints, work)] += 1
    return counts


def all_paths(g: Csr, s: int, t: int) -> list[list[int]]:
    """Every shortest path s -> t; none if t is s or out of reach. As many as there are, so for small graphs."""
    dist, _, _, links = g.paths(s)
    if s == t or dist[t] < 0:
        return []
    paths = [[t]]
    for a, b in reversed(links[: dist[t]]):
        before: dict[int, list[int]] = {}
        for x, y in zip(a.tolist(), b.tolist()):
            before.setdefault(y, []).append(x)
        paths = [[x, *p] for p in paths for x in before[p[0]]]
    return paths


def multi_path_counts(g: Csr, seed: int, phase: int, first: int, last: int, alpha: float = 2.3) -> np.ndarray:
    """floor(alpha times the number of shortest paths) of a pair's paths where there are several, else one; a vertex
    counts by its share of them."""
    counts, work = np.zeros(g.n), Workspace(g.n)
    for i in range(first, last):
        rng = np.random.default_rng((seed, phase, i))
        s, t = _pair(g, rng)
        dist, sigma, _, _ = g.paths(s)
        if dist[t] > 1:
            draws = int(alpha * sigma[t]) if alpha > 0 and sigma[t] > 1 else 1
            for _ in range(draws):
                counts[sample_path(g, s, t, rng, work=work)] += 1 / draws
    return counts


def rk_counts(g: Csr, seed: int, phase: int, first: int, last: int) -> np.ndarray:
    """One path between vertices that are no neighbours."""
    counts, work = np.zeros(g.n), Workspace(g.n)
    for i in range(first, last):
        rng = np.random.default_rng((seed, phase, i))
        while True:
            s, t = _pair(g, rng)
            if t not in g.out_to[g.out_at[s] : g.out_at[s + 1]]:
                break
        counts[sample_path(g, s, t, rng, work=work)] += 1
    return counts


def abra_counts(g: Csr, seed: int, phase: int, first: int, last: int) -> np.ndarray:
    """All shortest paths of a pair: sigma_sv sigma_vt / sigma_st."""
    counts = np.zeros(g.n)
    for i in range(first, last):
        rng = np.random.default_rng((seed, phase, i))
        s, t = _pair(g, rng)
        dist, sigma, _, links = g.paths(s)
        if dist[t] > 1:
            share = np.zeros(g.n)
            share[t] = 1.0
            for a, b in reversed(links[: dist[t]]):
                share += np.bincount(a, sigma[a] * share[b] / sigma[b], g.n)
            share[[s, t]] = 0
            counts += share
    return counts


def bp_counts(g: Csr, seed: int, phase: int, first: int, last: int) -> np.ndarray:
    """All paths of one source: its dependency over n - 1."""
    counts = np.zeros(g.n)
    for i in range(first, last):
        source = int(np.random.default_rng((seed, phase, i)).integers(g.n))
        counts += g.dependency(source) / (g.n - 1)
    return counts


KERNELS = {"rk": rk_counts, "abra": abra_counts, "bp": bp_counts, "multi": multi_path_counts}


class Sampler:
    """A broadcast graph on which batches of samples run as jobs."""

    def __init__(self, edges: DataFrame, seed: int = 0, limit: int = LIMIT):
        self.spark, self.seed, self.g = edges.sparkSession, seed, collected(edges, limit)
        self.sent = self.spark.sparkContext.broadcast(self.g)

    def batch(self, kernel, phase: int, first: int, last: int, rows: int = 1, **options) -> np.ndarray:
        """Summed counts of samples first..last-1: rows x n numbers, as small as the broadcast graph."""
        sent, seed, width = self.sent, self.seed, rows * self.g.n
        tasks = max(1, min((last - first) // 32, 2 * self.spark.sparkContext.defaultParallelism))
        cuts = np.linspace(first, last, tasks + 1).astype(int).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    total += kernel(sent.value, seed, phase, cuts[k], cuts[k + 1], **options)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.asarray(total)[some])], names=["v", "c"])

        got = self.spark.range(0, tasks, 1, tasks).mapInArrow(run, "v long, c double").groupBy("v").agg(F.sum("c").alias("c")).toArrow()
        out = np.zeros(width)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out


@dataclass
class Estimate:
    """Scores with bounds that all hold at once with probability 1 - delta."""

    scores: DataFrame  # id, score, lower, upper
    samples: int
    burn_in: int
    omega: float
    tracked: np.ndarray


def adaptive(
    edges: DataFrame, k: int = 0, err: float = 0.01, delta: float = 0.1, *, directed: bool = True, start_factor: float = 100, endpoints: bool = False,
    normalise: str = "graphs", variant: str = "paper_bd", seed: int = 0, batch: int | None = None,
) -> Estimate:
    """Betweenness within err of the truth for all vertices (k = 0), or the k largest told apart from the others.

    A burn-in of samples spreads delta over vertices; then batches run until the stopping test holds for counts and
    pairs of the same completed batch, or the worst-case number is reached. Burn-in samples do not count in the scores.
    """
    if err <= 0 or not 0 < delta < 1 or k < 0:
        raise ValueError("err has to be above 0, delta between 0 and 1, k not below 0")
    if variant not in bounds.VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    sampler = Sampler(edges, seed)
    g = sampler.g
    if g.n < 2:
        raise ValueError("two vertices are needed at least")
    factor = scale(g.n, normalise, directed)
    omega = bounds.worst_case_samples(diameter_bound(g, directed), err, delta)
    tau = bounds.burn_in(omega, start_factor)
    tracked_n = bounds.tracking_size(g.n, g.m, k)
    counts = sampler.batch(path_counts, 1, 0, tau, endpoints=endpoints)
    order = np.lexsort((np.arange(g.n), -counts))[:tracked_n]
    first = counts[order] / tau
    low, up = bounds.error_budgets(first, min(k, g.n), err, start_factor, variant)
    d_low, d_up = bounds.calibrated_deltas(first, low, up, g.n, err, delta)
    all_low, all_up = np.full(g.n, d_low[-1]), np.full(g.n, d_up[-1])
    all_low[order], all_up[order] = d_low, d_up
    counts, pairs, step = np.zeros(g.n), 0, batch or max(1000, tau // 10)
    while pairs < omega:
        last = min(pairs + step, int(np.ceil(omega)))
        counts += sampler.batch(path_counts, 2, pairs, last, endpoints=endpoints)
        pairs = last
        step += step // 2  # a job for each check, and at most half as many samples again as the test needs
        top = np.lexsort((np.arange(g.n), -counts))[:tracked_n]
        if bounds.finished(counts[top] / pairs, pairs, min(k, g.n), err, all_low[top], all_up[top], omega, variant):
            break
    b = counts / pairs
    lower = np.maximum(0, b - bounds.deviation_below(b, pairs, all_low, omega)) * factor
    upper = np.minimum(1, b + bounds.deviation_above(b, pairs, all_up, omega)) * factor
    table = pa.table([pa.array(g.ids), b * factor, lower, upper], names=["id", "score", "lower", "upper"])
    return Estimate(edges.sparkSession.createDataFrame(table), pairs, tau, omega, g.ids[order])


def top_k(edges: DataFrame, k: int, err: float = 0.01, delta: float = 0.1, **options) -> DataFrame:
    """(id, score, lower, upper) of every vertex that may be among the k largest, by falling score."""
    if k <= 0:
        raise ValueError("k has to be above 0")
    scores = adaptive(edges, k, err, delta, **options).scores
    kth = scores.orderBy(F.col("lower").desc(), "id").limit(k).agg(F.min("lower").alias("kth"))
    return scores.join(F.broadcast(kth)).where("upper >= kth").drop("kth").orderBy(F.col("score").desc(), "id")


def fixed(edges: DataFrame, estimator: str, samples: int, seed: int = 0) -> DataFrame:
    """(id, score): the share of pairs' paths through id, from samples draws of 'rk', 'abra', 'bp' or 'multi'."""
    sampler = Sampler(edges, seed)
    factor = _factor(sampler.g, estimator)
    counts = sampler.batch(KERNELS[estimator], 3, 0, samples)
    return edges.sparkSession.createDataFrame(pa.table([pa.array(sampler.g.ids), counts / samples * factor], names=["id", "score"]))


def _factor(g: Csr, estimator: str) -> float:
    """The share of ordered pairs that the estimator draws from; it has to be able to draw one."""
    if g.n < 2:
        raise ValueError("two vertices are needed at least")
    if estimator != "rk":
        return 1.0
    loops = int((np.repeat(np.arange(g.n), np.diff(g.out_at)) == g.out_to).sum())
    share = 1 - (g.m - loops) / (g.n * (g.n - 1))
    if share <= 0:
        raise ValueError("all pairs have an edge, so none can be drawn without one")
    return share


def timed(edges: DataFrame, estimator: str, seconds: float, seed: int = 0, first: int = 500, share: float = 0.75) -> tuple[DataFrame, int]:
    """fixed() for as many samples as a time allows, and their number: batches of what share of the time left should do."""
    sampler, done, counts = Sampler(edges, seed), 0, 0.0
    factor, began, size = _factor(sampler.g, estimator), time.monotonic(), first
    while True:
        started = time.monotonic()
        counts = counts + sampler.batch(KERNELS[estimator], 3, done, done + size)
        done += size
        now = time.monotonic()
        left = seconds - (now - began)
        if left <= 0:
            return edges.sparkSession.createDataFrame(pa.table([pa.array(sampler.g.ids), counts / done * factor], names=["id", "score"])), done
        size = max(1, int(size * share * left / max(now - started, 1e-3)))


def oracle_allocation(edges: DataFrame, truth: DataFrame, k: int, err: float = 0.01, delta: float = 0.1, start_factor: float = 100, variant: str = "paper_bd", directed: bool = True) -> DataFrame:
    """(id, share, low, up): how delta would be spread over the tracked vertices if the burn-in had found the exact
    shares of truth(id, score), scores being shares of ordered pairs."""
    g = collected(edges)
    omega = bounds.worst_case_samples(diameter_bound(g, directed), err, delta)
    tracked = truth.orderBy(F.col("score").desc(), "id").limit(bounds.tracking_size(g.n, g.m, k)).toArrow()
    share = tracked.column(tracked.column_names.index("score")).to_numpy()
    low, up = bounds.error_budgets(share, min(k, g.n), err, start_factor, variant)
    d_low, d_up = bounds.calibrated_deltas(share, low, up, g.n, err, delta)
    table = pa.table([tracked.column(tracked.column_names.index("id")), pa.array(share), pa.array(np.asarray(d_low, float)), pa.array(np.asarray(d_up, float)), pa.array(np.full(len(share), omega))], names=["id", "share", "low", "up", "omega"])
    return edges.sparkSession.createDataFrame(table)


def progressive(edges: DataFrame, err: float, delta: float = 0.1, trials: int = 25, growth: float = 1.2, seed: int = 0, first: int = 200, most: int = 1_000_000) -> tuple[DataFrame, int, float]:
    """Scores from pair sampling whose size grows until Monte-Carlo Rademacher averages bound the error by err.

    Returns (id, score), the samples taken and the bound. Vertices are peeled into partitions by their mean squares,
    and each partition has a bound of its own; the largest one counts.
    """
    sampler = Sampler(edges, seed)
    g = sampler.g
    _factor(g, "abra")
    size, done = first, 0
    sums, squares, signed = np.zeros(g.n), np.zeros(g.n), np.zeros((trials, g.n))
    stages = max(1, int(np.ceil(np.log(most / first) / np.log(growth))))
    while True:
        got = sampler.batch(_moments, 4, done, size, rows=2 + trials, trials=trials)
        sums, squares, signed = sums + got[: g.n], squares + got[g.n : 2 * g.n], signed + got[2 * g.n :].reshape(trials, g.n)
        done = size
        part = bounds.peeling_index(squares / done, done)
        share = delta / stages / max(1, len(np.unique(part)))
        bound = 0.0
        for p in np.unique(part):
            own = part == p
            mcera = float(np.mean((signed[:, own] / done).max(1)))
            bound = max(bound, bounds.peeled_error(mcera, float((squares[own] / done).max()), done, trials, share, single=own.sum() == 1))
        if bound <= err or done >= most:
            return edges.sparkSession.createDataFrame(pa.table([pa.array(g.ids), sums / done], names=["id", "score"])), done, bound
        size = min(most, int(size * growth) + 1)


def _moments(g: Csr, seed: int, phase: int, first: int, last: int, trials: int) -> np.ndarray:
    """Sums of f, f^2 and sign f for each vertex and trial, in a row."""
    out = np.zeros((2 + trials, g.n))
    for i in range(first, last):
        f = abra_counts(g, seed, phase, i, i + 1)
        sign = np.random.default_rng((seed, phase + 1, i)).integers(0, 2, trials) * 2 - 1
        some = np.flatnonzero(f)
        out[0, some] += f[some]
        out[1, some] += f[some] ** 2
        out[2:, some] += sign[:, None] * f[some]
    return out.ravel()
