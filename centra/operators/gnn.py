"""The two-stream graph network that ranks vertices: feature tables in, sparse products by joins, dense layers by row.

A vertex's state is an array column. Dense layers run on Arrow batches with broadcast weights of fixed size; sparse
products are joins with pre-aggregated array sums, so no task needs the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed

from .algebra import degree_masses, pagerank, pagerank_feature
from .graph import between, keep_columns, keep_rows, transpose, uniform, vertices

EPS = 1e-12


@dataclass
class Weights:
    embed: tuple[np.ndarray, np.ndarray]
    layers: list[tuple[np.ndarray, np.ndarray]]
    scorer: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def seeded(features: int, hidden: int = 12, layers: int = 2, seed: int = 0) -> Weights:
        rng = np.random.default_rng(seed)

        def dense(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            reach = (6 / (a + b)) ** 0.5
            return rng.uniform(-reach, reach, (a, b)), np.zeros(b)

        return Weights(dense(features, hidden), [dense(hidden, hidden) for _ in range(layers)], [dense(hidden, 2 * hidden), dense(2 * hidden, 2 * hidden), dense(2 * hidden, 1)])

    def save(self, path: str) -> None:
        flat = [x for pair in (self.embed, *self.layers, *self.scorer) for x in pair]
        np.savez(path, layers=len(self.layers), **{f"a{i}": x for i, x in enumerate(flat)})

    @staticmethod
    def load(path: str) -> Weights:
        with np.load(path) as f:
            n = int(f["layers"])
            flat = [f[f"a{i}"] for i in range(2 * (1 + n + 3))]
        pairs = list(zip(flat[::2], flat[1::2]))
        return Weights(pairs[0], pairs[1 : 1 + n], pairs[1 + n :])


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS)


def mlp(x: np.ndarray, scorer: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for i, (w, b) in enumerate(scorer):
        x = x @ w + b
        if i + 1 < len(scorer):
            x = np.maximum(x, 0)
    return x[:, 0]


def _rows(df: DataFrame, function, out: str) -> DataFrame:
    """(id, x, score) of df(id, x) by function(matrix) -> matrix, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                y, s = function(x)
                rows = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(s)], names=["id", "x", "score"])

    return df.select("id", "x").mapInArrow(run, "id long, x array<double>, score double")


def spmm(edges: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """(id, x): sums of the neighbours' arrays, place by place."""
    met = edges.join(x.select(F.col("id").alias("dst"), "x"), "dst")
    sums = met.groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)))
    return sums.select("id", F.array(*(F.col(f"s{i}") for i in range(width))).alias("x"))


def stream(edges: DataFrame, features: DataFrame, weights: Weights) -> DataFrame:
    """(id, score): scores after the embedding and after each layer, added up; features(id, x)."""
    width = weights.embed[0].shape[1]

    def embed(x: np.ndarray):
        y = unit(np.maximum(x @ weights.embed[0] + weights.embed[1], 0))
        return y, mlp(y, weights.scorer)

    state = checkpointed(_rows(features, embed, "x"))
    total = state.select("id", "score")
    for k, (w, b) in enumerate(weights.layers):
        last = k + 1 == len(weights.layers)

        def project(x: np.ndarray, w=w):
            return x @ w, np.zeros(len(x))

        def activate(x: np.ndarray, b=b, last=last):
            y = np.maximum(x + b, 0)
            y = y if last else unit(y)
            return y, mlp(y, weights.scorer)

        summed = spmm(edges, _rows(state, project, "x"), width)
        zeros = F.array(*(F.lit(0.0) for _ in range(width)))
        filled = state.select("id").join(summed, "id", "left").select("id", F.coalesce("x", zeros).alias("x"))
        state = checkpointed(_rows(filled, activate, "x"))
        total = total.join(state.select("id", F.col("score").alias("more")), "id").select("id", (F.col("score") + F.col("more")).alias("score"))
    return total


def as_features(table: DataFrame) -> DataFrame:
    return table.select("id", F.array(*(F.col(c).cast("double") for c in table.columns if c != "id")).alias("x"))


def deep_scores(edges: DataFrame, weights: Weights, kind: str = "betweenness", hops: int = 6) -> DataFrame:
    """(id, score) of the two deeper models; weights hold one embedding and its layers.

    betweenness: five layers (the embedding and four more) over A and A', products of both streams' scores; the second
    stream's last layer has the weights of the one before it. closeness: seven layers, the embedding over A and the
    others over A' masked by columns; the sum of the scores.
    """
    kept = checkpointed(between(edges))
    if kind == "closeness":
        ids = vertices(edges)
        features = as_features(ids.join(degree_masses(edges, hops), "id", "left").fillna(0.0))
        return stream(checkpointed(keep_columns(transpose(edges), kept)), features, weights)
    if kind != "betweenness":
        raise ValueError(f"unknown model {kind!r}")
    forth, back = checkpointed(keep_rows(edges, kept)), checkpointed(keep_rows(transpose(edges), kept))
    ids = vertices(edges)
    own = lambda e: as_features(ids.join(degree_masses(e, hops), "id", "left").fillna(0.0))
    shared = Weights(weights.embed, [*weights.layers[:-1], weights.layers[-2]], weights.scorer)
    both = stream(forth, own(forth), weights).join(stream(back, own(back), shared).withColumnRenamed("score", "other"), "id")
    return both.select("id", (F.col("score") * F.col("other")).alias("score"))


def master_update(state: np.ndarray, rows: DataFrame, update: tuple[np.ndarray, np.ndarray], share: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The next global state from the last one and the mean of rows(id, x), and what it sends to all vertices."""
    width = len(state)
    mean = rows.agg(*(F.avg(F.col("x")[i]) for i in range(width))).first()
    new = np.tanh(np.concatenate([state, [v or 0.0 for v in mean]]) @ update[0] + update[1])
    return new, new @ share[0] + share[1]


def rank_scores(
    edges: DataFrame, weights: Weights, hops: int = 6, use_pagerank: bool = False, fusion: str = "mul",
    back_scorer: list[tuple[np.ndarray, np.ndarray]] | None = None, head: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """(id, score): both streams share the weights, or have scorers of their own if back_scorer is given; rows of masked
    vertices are cut from A and, after transposing, from A' as well.

    fusion: mul or add; cat_mlp, a layer over both scores and one over that, given as head; back, the second stream.
    """
    kept = checkpointed(between(edges))
    ids = vertices(edges)
    forth, back = checkpointed(keep_rows(edges, kept)), checkpointed(keep_rows(transpose(edges), kept))
    pr = pagerank_feature(pagerank(edges)).withColumnRenamed("value", "pr") if use_pagerank else None

    def features(e: DataFrame) -> DataFrame:
        masses = ids.join(degree_masses(e, hops), "id", "left").fillna(0.0)
        return as_features(masses if pr is None else masses.join(pr, "id"))

    b = stream(back, features(back), Weights(weights.embed, weights.layers, back_scorer or weights.scorer))
    if fusion == "back":
        return b
    both = stream(forth, features(forth), weights).join(b.withColumnRenamed("score", "other"), "id")
    x, y = F.col("score"), F.col("other")
    if fusion == "cat_mlp":
        (w, c), (v, d) = head
        fused = F.lit(float(d[0]))
        for j in range(w.shape[1]):
            fused = fused + float(v[j, 0]) * F.greatest(F.lit(0.0), x * float(w[0, j]) + y * float(w[1, j]) + float(c[j]))
    else:
        fused = {"mul": x * y, "add": x + y}[fusion]
    return both.select("id", fused.alias("score"))


def pairs(truth: DataFrame, per_vertex: int = 20, seed: int = 0) -> DataFrame:
    """(s, t, y): random pairs of vertices with different truth, y the sign of the difference; truth(id, score)."""
    n = truth.count()
    from centra.functions.numbering import numbered

    named = checkpointed(numbered(truth.select("id", "score"), [F.col("id")]))
    drawn = named.select("id", "score", F.explode(F.sequence(F.lit(1), F.lit(per_vertex))).alias("i"))
    partner = F.floor(uniform(seed, "id", "i") * max(n, 1)).cast("long")
    other = named.select(F.col("n").alias("p"), F.col("id").alias("t"), F.col("score").alias("other"))
    met = drawn.withColumn("p", partner).join(other, "p")
    return met.where("score != other").select(F.col("id").alias("s"), "t", F.signum(F.col("score") - F.col("other")).alias("y"))


# --- training, on graphs that fit the driver


class _Sparse:
    """A matrix of a graph of bounded size as rows (at, to) with an optional row mask, times dense ones."""

    def __init__(self, at: np.ndarray, to: np.ndarray, kept: np.ndarray):
        src = np.repeat(np.arange(len(at) - 1), np.diff(at))
        own = kept[src]
        self.src, self.dst, self.n = src[own], to[own], len(at) - 1

    def times(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        a, b = (self.dst, self.src) if transposed else (self.src, self.dst)
        return np.stack([np.bincount(a, x[b, j], self.n) for j in range(x.shape[1])], 1)

    def masses(self, hops: int) -> np.ndarray:
        x, total, out = np.ones((self.n, 1)), 0.0, []
        for _ in range(hops):
            x = self.times(x)
            total = total + x
            out.append(np.log1p(total))
        return np.hstack(out)


def _mlp_back(x: np.ndarray, scorer, d: np.ndarray, grads: list) -> np.ndarray:
    """Gradient of mlp at x for output gradient d; weight gradients are added to grads."""
    inputs, h = [], x
    for i, (w, b) in enumerate(scorer):
        inputs.append(h)
        h = h @ w + b
        if i + 1 < len(scorer):
            h = np.maximum(h, 0)
    d = d[:, None]
    for i in range(len(scorer) - 1, -1, -1):
        grads[i][0] += inputs[i].T @ d
        grads[i][1] += d.sum(0)
        d = d @ scorer[i][0].T
        if i:
            d = d * (inputs[i] > 0)
    return d


def _unit_back(y: np.ndarray, d: np.ndarray) -> np.ndarray:
    norm = np.sqrt((y * y).sum(1, keepdims=True)) + EPS
    x = y / norm
    return (d - x * (d * x).sum(1, keepdims=True)) / norm


def stream_forward(a: _Sparse, features: np.ndarray, w: Weights) -> tuple[np.ndarray, list]:
    """Scores, and what the way back needs: each layer's sums before the cut at 0 and its output."""
    y = features @ w.embed[0] + w.embed[1]
    x = unit(np.maximum(y, 0))
    tape, score = [(y, x)], mlp(x, w.scorer)
    for k, (weight, bias) in enumerate(w.layers):
        y = a.times(x @ weight) + bias
        x = np.maximum(y, 0) if k + 1 == len(w.layers) else unit(np.maximum(y, 0))
        tape.append((y, x))
        score = score + mlp(x, w.scorer)
    return score, tape


def stream_backward(a: _Sparse, features: np.ndarray, w: Weights, tape: list, d: np.ndarray, grads: Weights) -> None:
    down = None
    for k in range(len(w.layers), -1, -1):
        y, x = tape[k]
        dx = _mlp_back(x, w.scorer, d, grads.scorer)
        dx = dx if down is None else dx + down
        dy = (dx if k and k == len(w.layers) else _unit_back(np.maximum(y, 0), dx)) * (y > 0)
        if k:
            weight, before = w.layers[k - 1][0], tape[k - 1][1]
            back = a.times(dy, transposed=True)
            grads.layers[k - 1][0][:] += before.T @ back
            grads.layers[k - 1][1][:] += dy.sum(0)
            down = back @ weight.T
        else:
            grads.embed[0][:] += features.T @ dy
            grads.embed[1][:] += dy.sum(0)


def loss_and_gradient(streams: list[tuple[_Sparse, np.ndarray]], w: Weights, s: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Margin ranking loss of the product of both streams' scores over pairs, and its gradient."""
    zero = lambda pairs_: [(np.zeros_like(p), np.zeros_like(q)) for p, q in pairs_]
    grads = Weights(zero([w.embed])[0], zero(w.layers), [list(p) for p in zero(w.scorer)])
    (a, tape_a), (b, tape_b) = (stream_forward(m, f, w) for m, f in streams)
    score = a * b
    margin = 1 - y * (score[s] - score[t])
    on = margin > 0
    d = np.zeros(len(score))
    step = np.where(on, -y, 0.0) / max(len(y), 1)
    np.add.at(d, s, step)
    np.add.at(d, t, -step)
    for (m, f), tape, other in zip(streams, (tape_a, tape_b), (b, a)):
        stream_backward(m, f, w, tape, d * other, grads)
    return float(np.where(on, margin, 0).mean()), grads


def train(edges: DataFrame, truth: DataFrame, hops: int = 5, hidden: int = 12, layers: int = 2, epochs: int = 10, rate: float = 5e-3, per_vertex: int = 20, seed: int = 0) -> tuple[Weights, list[float]]:
    """Weights fitted to rank vertices by truth(id, score) with Adam, and the loss of each epoch. The graph's size is
    checked before it comes to the driver; larger graphs are ranked with weights from smaller ones."""
    from .csr import collected

    g = collected(edges)
    kept = np.zeros(g.n, bool)
    kept[np.searchsorted(g.ids, between(edges).toArrow().column(0).to_numpy())] = True
    streams = [(m, m.masses(hops)) for m in (_Sparse(g.out_at, g.out_to, kept), _Sparse(g.in_at, g.in_to, kept))]
    table = truth.toArrow()
    score = np.zeros(g.n)
    score[np.searchsorted(g.ids, table.column("id").to_numpy())] = table.column("score").to_numpy()
    w, rng, losses = Weights.seeded(hops, hidden, layers, seed), np.random.default_rng(seed), []
    flat = lambda x: [p for pair in (x.embed, *x.layers, *x.scorer) for p in pair]
    first, second = [np.zeros_like(p) for p in flat(w)], [np.zeros_like(p) for p in flat(w)]
    for step in range(1, epochs + 1):
        s, t = rng.integers(g.n, size=per_vertex * g.n), rng.integers(g.n, size=per_vertex * g.n)
        unlike = score[s] != score[t]
        s, t = s[unlike], t[unlike]
        loss, grads = loss_and_gradient(streams, w, s, t, np.sign(score[s] - score[t]))
        losses.append(loss)
        for p, d, m, v in zip(flat(w), flat(grads), first, second):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, losses
