"""Sparse linear algebra over edge tables: each step is a join on the vertex and a pre-aggregated sum."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed, spread

from .graph import transpose, uniform, vertices

#: Steps between checkpoints of a loop's vector.
EVERY = 4


def spmv(edges: DataFrame, x: DataFrame, how=F.sum, rows: int = 0) -> DataFrame:
    """(id, value): for each row vertex, how over the values of its neighbours; x(id, value). rows, if known, is how many
    edges there are, and bounds what a task joins."""
    met = spread(edges, rows, "dst").join(x.select(F.col("id").alias("dst"), "value"), "dst")
    return met.groupBy("src").agg(how("value").alias("value")).withColumnRenamed("src", "id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, deg, indeg) of all endpoints, 0 where there is none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("deg"), F.sum("x.i").alias("indeg"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, score): neighbours over n - 1."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.col("deg") / (F.col("n") - 1)).otherwise(0.0).alias("score"))


def hops(edges: DataFrame, seed: DataFrame, m: int, how=F.sum) -> DataFrame:
    """(id, d1 .. dm): seed(id, value) multiplied by the adjacency m times, 0 where nothing arrives."""
    edges = checkpointed(edges.select("src", "dst"))
    out, x, rows = seed.select("id"), seed, edges.count()
    for k in range(1, m + 1):
        x = spmv(edges, x, how, rows)
        if k % EVERY == 0:
            x = checkpointed(x)
        out = out.join(x.withColumnRenamed("value", f"d{k}"), "id", "left").fillna(0, [f"d{k}"])
    return out


def _ones(edges: DataFrame) -> DataFrame:
    return vertices(edges).withColumn("value", F.lit(1.0))


def degree_masses(edges: DataFrame, m: int = 5, log: bool = True, running: bool = True) -> DataFrame:
    """(id, mass1 .. massm): running sums of d_k = A d_{k-1}, d_1 = A 1, as log1p."""
    d = hops(edges, _ones(edges), m)
    total, cols = F.lit(0.0), []
    for k in range(1, m + 1):
        total = total + F.col(f"d{k}") if running else F.col(f"d{k}")
        cols.append((F.log1p(total) if log else total).alias(f"mass{k}"))
    return d.select("id", *cols)


def degree_mass_score(edges: DataFrame, m: int, directed: bool) -> DataFrame:
    """(id, score): d^(0..m) summed, out times in on directed graphs."""

    def mass(e: DataFrame) -> DataFrame:
        return degree_masses(e, m + 1, log=False).select("id", F.col(f"mass{m + 1}").alias("score"))

    if not directed:
        return mass(edges)
    back = mass(transpose(edges)).withColumnRenamed("score", "back")
    return mass(edges).join(back, "id").select("id", (F.col("score") * F.col("back")).alias("score"))


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(id, value): p <- alpha P' p + (1 - alpha) / n from 1 / n; the mass of vertices without a way out is lost."""
    ids = checkpointed(vertices(edges))
    n = ids.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = checkpointed(edges.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("w")))
    p = ids.withColumn("value", F.lit(1.0 / n if n else 0.0))
    for step in range(1, iterations + 1):
        met = weighted.join(p.select(F.col("id").alias("src"), "value"), "src")
        moved = met.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("got"))
        new = ids.join(moved, "id", "left").select("id", (F.coalesce("got", F.lit(0.0)) * alpha + (1 - alpha) / max(n, 1)).alias("value"))
        if step % EVERY == 0:  # each check is a job, and so is each checkpoint
            new = checkpointed(new)
            if tolerance > 0:
                was = checkpointed(p.withColumnRenamed("value", "was"))
                change = new.join(was, "id").agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] or 0.0
                if change < tolerance:
                    return new
        p = new
    return p


def max_norm(x: DataFrame, columns: list[str]) -> DataFrame:
    """Columns over their largest value plus 1e-6."""
    top = x.agg(*(F.max(c).alias(f"__{c}") for c in columns))
    return x.join(F.broadcast(top)).select(*(c for c in x.columns if c not in columns), *((F.col(c) / (F.col(f"__{c}") + 1e-6)).alias(c) for c in columns))


def pagerank_feature(p: DataFrame, normalised: bool = True) -> DataFrame:
    n = p.agg(F.count("*").alias("n"))
    x = p.join(F.broadcast(n)).select("id", F.log1p(F.col("value") * F.col("n")).alias("value"))
    return max_norm(x, ["value"]) if normalised else x


def eigenvector(edges: DataFrame, iterations: int = 5) -> DataFrame:
    """(id, value) after power iterations from ones, each scaled to length 1."""
    edges = checkpointed(edges.select("src", "dst"))
    ids = checkpointed(vertices(edges))
    x, rows = ids.withColumn("value", F.lit(1.0)), edges.count()
    for _ in range(iterations):
        x = checkpointed(ids.join(spmv(edges, x, rows=rows), "id", "left").fillna(0.0, ["value"]))
        norm = math.sqrt(x.agg(F.sum(F.col("value") ** 2)).first()[0] or 0.0)
        x = x.withColumn("value", F.col("value") / F.lit(norm or 1.0))
    return x


def eigenvector_mass(edges: DataFrame, m: int = 3, iterations: int = 5, running: bool = True) -> DataFrame:
    """(id, mass1 .. massm) as log1p, from the seed ev n / (deg + 1)."""
    ev, d = eigenvector(edges, iterations), degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    seed = ev.join(d, "id").join(F.broadcast(n)).select("id", (F.col("value") * F.col("n") / (F.col("deg") + 1)).alias("value"))
    got = hops(edges, checkpointed(seed), m)
    total, cols = F.lit(0.0), []
    for k in range(1, m + 1):
        total = total + F.col(f"d{k}") if running else F.col(f"d{k}")
        cols.append(F.log1p(total).alias(f"mass{k}"))
    return got.select("id", *cols)


def leverage(edges: DataFrame) -> DataFrame:
    """(id, value): 2 * sum over the row of 1 / (deg_r + deg_c), less 1."""
    edges = checkpointed(edges.select("src", "dst"))
    d, rows = checkpointed(degrees(edges).select("id", "deg")), edges.count()
    met = spread(edges, rows, "dst").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("b")), "dst")
    met = spread(met, rows, "src").join(d.select(F.col("id").alias("src"), F.col("deg").alias("a")), "src")
    got = met.groupBy(F.col("src").alias("id")).agg(F.sum(1.0 / (F.col("a") + F.col("b"))).alias("s"))
    return d.join(got, "id", "left").select("id", (2 * F.coalesce("s", F.lit(0.0)) - 1).alias("value"))


def sinusoid(position: Column, i: int, width: int) -> Column:
    """Place i of a sinusoidal encoding of position."""
    angle = position / F.lit(10000.0 ** (2 * (i // 2) / width))
    return F.sin(angle) if i % 2 == 0 else F.cos(angle)


def features(edges: DataFrame, kind: str, width: int = 12, normalised: bool = False) -> DataFrame:
    """(id, c1 .. cm): the starting features of one kind, as log1p but for degree0, degree_embedding (the degree as an
    index below width), random_m and the encodings, which have width places for each degree; normalised over their
    maxima if wanted.

    d1 is the degree, d_k the sum of d_(k-1) over the neighbours, m_k their maximum (0 without any).
    """
    ones = _ones(edges)
    if m := re.fullmatch(r"random_(\d+)", kind):
        far = lambda i, side: F.greatest(uniform(2 * i + side, "id"), F.lit(2.0**-53))
        normal = lambda i: F.sqrt(-2 * F.log(far(i, 0))) * F.cos(2 * math.pi * far(i, 1))
        return ones.select("id", *(normal(i).alias(f"c{i + 1}") for i in range(int(m[1]))))
    if m := re.fullmatch(r"ev_mix_(mass|independent)_(\d+)", kind):
        got = eigenvector_mass(edges, int(m[2]), running=m[1] == "mass")
        return _channels(got.select("id", *(F.expm1(c) for c in got.columns[1:])), True, normalised)
    depth = {"degree0": 1, "degree_embedding": 1, "positional_encoding": 1, "degree1": 1, "degree_pure": 1, "degree2": 2, "degree": 2, "degree_mix_sum_2": 2}
    growing = re.fullmatch(r"degree_mix_(mass|independent)_(\d+)", kind)
    d = hops(edges, ones, int(growing[2]) if growing else depth.get(kind, 3)).drop("value")
    c = F.col
    if kind == "degree0":
        return d.select("id", F.lit(1.0).alias("c1"))
    if kind == "degree_embedding":
        return d.select("id", F.least(c("d1"), F.lit(width - 1.0)).cast("int").alias("c1"))
    if kind in ("positional_encoding", "positional_encoding_3d"):
        own = [c("d1")] if kind == "positional_encoding" else [c("d1"), c("d2"), c("d3")]
        return d.select("id", *(sinusoid(x, i, width).alias(f"c{k * width + i + 1}") for k, x in enumerate(own) for i in range(width)))
    if kind in ("degree_mix_max", "degree_mix_max_sum"):
        top = hops(edges, d.select("id", c("d1").alias("value")), 2, F.max).select(c("id").alias("of"), c("d1").alias("m2"), c("d2").alias("m3"))
        both = d.join(top, c("id") == c("of"))
        most = [c("d1"), c("m2"), c("m3")]
        return _channels(both.select("id", *(most if kind == "degree_mix_max" else [c("d1"), c("d2"), c("d3"), *most])), True, normalised)
    if growing:
        own = [c(x) for x in d.columns[1:]]
        if growing[1] == "mass":
            own = [sum(own[1 : i + 1], own[0]) for i in range(len(own))]
    else:
        known = {
            "degree1": [c("d1")], "degree_pure": [c("d1")], "degree2": ["d2"], "degree": ["d2"], "degree3": ["d3"], "degree_mix_sum": ["d1", "d2", "d3"],
            "degree_mix_sum_2": ["d1", "d2"], "degree_mix_d0d2": [c("d1"), c("d1") + c("d2") + c("d3")],
        }
        if kind not in known:
            raise ValueError(f"unknown feature {kind!r}")
        own = [c(x) if isinstance(x, str) else x for x in known[kind]]
    return _channels(d.select("id", *own), True, normalised)


def _channels(x: DataFrame, log: bool, normalised: bool) -> DataFrame:
    named = x.toDF("id", *(f"c{i}" for i in range(1, len(x.columns))))
    named = named.select("id", *((F.log1p(c) if log else F.col(c)).alias(c) for c in named.columns[1:]))
    return max_norm(named, named.columns[1:]) if normalised else named


def parse_init_type(kind: str) -> dict:
    """'AW_pr_sp8_ff' -> base, whether with PageRank, and how many landmarks chosen how."""
    base, pr, landmarks, mode = kind, False, 0, None
    if m := re.search(r"_sp(\d+)_(ff|deg|random|stats)$", base):
        base, landmarks, mode = base[: m.start()], int(m[1]), m[2]
    if base.endswith("_pr"):
        base, pr = base[:-3], True
    return {"base": base, "pagerank": pr, "landmarks": landmarks, "mode": mode}
