"""Sample sizes, deviations and stopping rules of the sampling estimators, as plain functions over numbers and arrays."""

from __future__ import annotations

import math

import numpy as np

VARIANTS = ("code", "cpp", "paper", "paper_bd", "paper_ex")
FREE = 10.0  # an error budget that constrains nothing
BETA = 0.001


def worst_case_samples(diameter: float, err: float, delta: float) -> float:
    return 0.5 / err**2 * (math.log2(max(diameter, 2) - 1) + 1 + math.log(0.5 / delta))


def burn_in(omega: float, start_factor: float = 100) -> int:
    return max(round(omega / start_factor), 1)


def tracking_size(n: int, m: int, k: int, share: int = 8) -> int:
    """How many vertices the stopping test follows; share is an option, so that results do not hang on parallelism."""
    return min(n, int(max(2 * math.sqrt(m) / share, k + 20)))


def deviation_below(b: np.ndarray, pairs: float, delta: np.ndarray, omega: float) -> np.ndarray:
    log, a = np.log(1 / np.asarray(delta)), omega / pairs - 1 / 3
    return np.minimum(log / pairs * (-a + np.sqrt(a * a + 2 * np.asarray(b) * omega / log)), b)


def deviation_above(b: np.ndarray, pairs: float, delta: np.ndarray, omega: float) -> np.ndarray:
    log, c = np.log(1 / np.asarray(delta)), omega / pairs + 1 / 3
    return np.minimum(log / pairs * (c + np.sqrt(c * c + 2 * np.asarray(b) * omega / log)), 1 - np.asarray(b))


def error_budgets(b: np.ndarray, k: int, err: float, start_factor: float = 100, variant: str = "paper_bd") -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper budgets of vertices sorted by falling b; every one gets err without a k or with too few of them."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    t = len(b)
    if k == 0 or t <= k:
        return np.full(t, err), np.full(t, err)
    paper = variant.startswith("paper")
    half = (b[:-1] - b[1:]) / 2
    next_gap = np.append(half, 0.0)
    last_gap = np.concatenate(([FREE], half))
    inner, outer = np.maximum(err, next_gap), np.maximum(err, last_gap)
    outer[0] = FREE
    low, up = (inner, outer) if paper else (outer, inner)
    low, up = low.copy(), up.copy()
    rest = np.arange(t) >= k
    low[rest] = FREE
    up[rest] = np.maximum(err, b[k - 1] + (-half[k - 1] if paper else half[k - 1]) - b[rest])
    close = math.sqrt(start_factor) * err / 4
    for i in range(k - 1):
        if b[i] - b[i + 1] < close:
            low[[i, i + 1]] = up[[i, i + 1]] = err
    if variant == "paper_bd" and b[k - 1] - b[k] < close:
        low[[k - 1, k]] = up[[k - 1, k]] = err
    anchor, first = (k - 1, k) if variant == "paper_ex" else (k, k + 1)
    for i in range(first, t):
        if b[anchor] - b[i] < close:
            low[[i, anchor]] = up[[i, anchor]] = err
    return low, up


def calibrated_deltas(b: np.ndarray, low: np.ndarray, up: np.ndarray, n: int, err: float, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Failure shares of tracked vertices; vertices beyond them use the last one's. Their sum stays under delta / 2."""
    t = len(b)

    def shares(c: float) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = [np.exp(np.where(b > 0, -c * e * e / np.where(b > 0, b, 1), -np.inf)) for e in (low, up)]
        return out[0], out[1]

    left, right = 0.0, math.log(4 * n * (1 - BETA) / delta) / err**2
    while right - left > err / 10:
        c = (left + right) / 2
        a, z = shares(c)
        if a.sum() + z.sum() + (n - t) * (a[-1] + z[-1]) >= delta / 2 * (1 - BETA):
            left = c
        else:
            right = c
    a, z = shares(right)
    floor = delta * BETA / 4 / n
    return a + floor, z + floor


def finished(b: np.ndarray, pairs: float, k: int, err: float, delta_low: np.ndarray, delta_up: np.ndarray, omega: float, variant: str = "paper_bd") -> bool:
    """Whether tracked vertices, sorted by falling b, are all close enough or, with a k, apart from their neighbours."""
    f, g = deviation_below(b, pairs, delta_low, omega), deviation_above(b, pairs, delta_up, omega)
    close = (f < err) & (g < err)
    if k == 0:
        return bool(close.all())
    t = len(b)
    low, high = b - f, b + g
    above = np.append(low[:-1] > high[1:], True)  # apart from the next one
    below = np.concatenate(([True], above[:-1]))
    ok = np.empty(t, bool)
    ok[:k] = (above & below)[:k]
    if k < t:
        top = b[k - 1] - f[k - 1]
        ok[k:] = top > b[k:] + (np.full(t - k, g[k - 1]) if variant == "cpp" else g[k:])
    return bool((ok | close).all())


def vc_sample_error(vertex_diameter: int, m: int, delta: float) -> float:
    """Path sampling: error after m samples by the VC dimension of shortest paths."""
    return math.sqrt((math.floor(math.log2(max(vertex_diameter - 2, 1))) + 1 - math.log(delta)) / m)


def vc_sample_size(vertex_diameter: int, err: float, delta: float) -> int:
    return math.ceil((math.floor(math.log2(max(vertex_diameter - 2, 1))) + 1 - math.log(delta)) / err**2)


def source_sample_error(n: int, m: int, delta: float) -> float:
    """Source sampling: error after m sources by a union bound."""
    return math.sqrt((math.log(n) + math.log(2) - math.log(delta)) / (2 * m))


def pair_sample_error(wimpy: float, n: int, m: int, delta: float) -> float:
    """Pair sampling: error after m pairs by Massart's lemma; wimpy is the largest mean square."""
    era, lam = math.sqrt(2 * wimpy * math.log(n) / m), math.log(3 / delta)
    return 2 * era + (lam + math.sqrt(lam * (lam + 4 * m * era))) / m + math.sqrt(lam / (2 * m))


def hoeffding_size(err: float, delta: float) -> int:
    return math.ceil(2 * math.log(2 / delta) / err**2)


def peeled_error(mcera: float, wimpy: float, m: int, trials: int, delta: float, parts: int | None = None, single: bool = False) -> float:
    """Error of a partition from its Monte-Carlo Rademacher average and largest mean square."""
    t = math.log(5 / delta) / m
    variance = min(wimpy + t + math.sqrt(t * t + 2 * t * wimpy), 0.25)
    era = max(mcera, 0.0) + math.sqrt(4 * wimpy * t / trials)
    rade = 0.0 if single else era + t + math.sqrt(t * t + 2 * t * era)
    best = min(2 * rade + math.sqrt(2 * t * (variance + 4 * rade)) + t / 3, 2 * rade + math.sqrt(t / 2))
    if parts:
        s = math.log(5 * parts / delta) / m
        best = min(best, math.sqrt(2 * variance * s) + s / 3)
    return best


def rademacher_error(mcera: float, wimpy: float, m: int, trials: int, delta: float) -> float:
    """Error of all vertices together from the same two figures, with other constants."""
    t = math.log(5 / delta) / m
    w = wimpy + 2 * t / 3 + math.sqrt(t * t / 3 + 2 * wimpy * t)
    era = max(mcera, 0.0) + 2 * t / (3 * trials) + math.sqrt(4 * wimpy * t / trials)
    rade = era + t / 3 + math.sqrt(t * t / 12 + era * t)
    return 2 * rade + math.sqrt(2 * t * (w + 4 * rade)) + t / 3


def peeling_index(wimpy: np.ndarray, m: int, base: float = 2.0) -> np.ndarray:
    with np.errstate(divide="ignore"):
        reach = np.minimum(np.where(wimpy > 0, 1 / np.where(wimpy > 0, wimpy, 1), np.inf), m)
    return np.floor(np.log(reach) / math.log(base) + 1).astype(int)


def gcn_flops(nodes: int, edges: int, widths: list[int]) -> int:
    return sum(2 * nodes * a * b + 2 * edges * b for a, b in zip(widths, widths[1:]))


def unfinished(b: np.ndarray, pairs: float, k: int, err: float, delta_low: np.ndarray, delta_up: np.ndarray, omega: float) -> np.ndarray:
    """Places of tracked vertices whose deviations are not below err yet."""
    f, g = deviation_below(b, pairs, delta_low, omega), deviation_above(b, pairs, delta_up, omega)
    return np.flatnonzero((f >= err) | (g >= err))


def predicted_stop(b: np.ndarray, k: int, err: float, delta_low: np.ndarray, delta_up: np.ndarray, omega: float, variant: str = "paper_bd") -> int:
    """The least number of pairs at which the stopping test holds if the estimates stay as they are; omega at most."""
    low, high = 1, math.ceil(omega)
    while low < high:
        middle = (low + high) // 2
        if finished(b, middle, k, err, delta_low, delta_up, omega, variant):
            high = middle
        else:
            low = middle + 1
    return low


def source_samples(n: int, err: float, delta: float) -> int:
    """Sources that bound every vertex's error by err: the inverse of the bound for single sources."""
    return int(np.ceil((np.log(n) + np.log(2) - np.log(delta)) / (2 * err * err)))


def schedule(least: int, most: int, growth: float = 1.2) -> list[int]:
    """Sample sizes from least to most, each growth times the one before, rounded up."""
    out = [max(1, least)]
    while out[-1] < most:
        out.append(min(most, max(out[-1] + 1, int(np.ceil(out[-1] * growth)))))
    return out


class Congruential:
    """The linear congruential generator of 64 bits with MMIX's constants; numbers below m come without bias."""

    FACTOR, STEP = 6364136223846793005, 1442695040888963407  # fixed values

    def __init__(self, seed: int):
        self.state = seed % 2**64

    def next(self) -> int:
        self.state = (self.state * self.FACTOR + self.STEP) % 2**64
        return self.state

    def below(self, m: int) -> int:
        whole = 2**64 - 2**64 % m
        while (r := self.next()) >= whole:
            pass
        return r % m
