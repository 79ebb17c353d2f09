"""Breadth-first search by joins, and what follows from it: eccentricities, components, diameter bounds, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed

from .components import components
from .csr import LIMIT, Csr, collected
from .graph import degrees_of, drop_loops, symmetrise, vertices

#: Sources up to which joins search a graph that could be broadcast.
FEW = 64
#: Rows of a batch that a search hands on.
ROWS = 1 << 16


def bfs(edges: DataFrame, sources: DataFrame, most: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(source, node, dist, sigma): distances from all of sources(id) at once, and the numbers of shortest paths.

    Many sources are dealt over tasks that walk a broadcast graph of up to limit edges. Else one join, one pre-aggregated
    sum and one anti join for each level; nothing but the size of a level is collected.
    """
    edges = checkpointed(edges.select("src", "dst"))
    if starts := _dealt(edges, sources, limit):
        return _walked(edges, starts, most)
    level = checkpointed(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")).distinct())
    seen = level
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = level.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        level = checkpointed(new.select("source", "node", F.lit(depth).alias("dist"), "sigma"))
        if not level.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(level))
    return seen


def _dealt(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame | None:
    """The distinct sources, dealt over tasks; None if joins should search."""
    if edges.limit(limit + 1).count() > limit:
        return None
    ids = checkpointed(sources.select("id").distinct())
    if ids.limit(FEW + 1).count() <= FEW:
        return None
    return ids.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "id")


def _walked(edges: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    sent = edges.sparkSession.sparkContext.broadcast(collected(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, n = sent.value, [], 0
        work = np.full(g.n, -1, np.int32), np.zeros(g.n)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["source", "node", "dist", "sigma"])

        for batch in batches:
            for s, v in zip(batch.column(0).to_numpy(), g.places(batch.column(0).to_numpy())):
                if v < 0:
                    held.append((np.array([s]), np.array([s]), np.zeros(1, np.int32), np.ones(1)))
                else:
                    met = np.concatenate(g.paths(v, work, most)[2])
                    held.append((np.full(len(met), s), g.ids[met], work[0][met], work[1][met]))
                    work[0][met], work[1][met] = -1, 0
                n += len(held[-1][0])
                if n >= ROWS:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    return starts.mapInArrow(run, "source long, node long, dist int, sigma double")


def _summed(edges: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """(source, r, total, far) of each of sources(id): how many are reached, and the sum and largest of their distances."""
    edges = checkpointed(edges.select("src", "dst"))
    if (starts := _dealt(edges, sources, limit)) is None:
        return bfs(edges, sources, limit=0).groupBy("source").agg(F.count("*").alias("r"), F.sum("dist").alias("total"), F.max("dist").alias("far"))
    sent = edges.sparkSession.sparkContext.broadcast(collected(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # the bits of a word
                ids = batch.column(0)[a : a + 64].to_numpy()
                at = g.places(ids)
                r, total, far = np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
                if (own := at >= 0).any():
                    counts = g.reached(at[own])
                    level = np.arange(len(counts))
                    r[own], total[own], far[own] = counts.sum(0), level @ counts, ((counts > 0) * level[:, None]).max(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(r), pa.array(total), pa.array(far)], names=["source", "r", "total", "far"])

    return starts.mapInArrow(run, "source long, r long, total long, far int")


def dependencies(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, node, dep) from bfs(): dep[p] += sigma[p] (1 + dep[w]) / sigma[w], the farthest levels first."""
    edges = checkpointed(edges.select("src", "dst"))
    depth = reached.agg(F.max("dist")).first()[0] or 0
    done = reached.where(F.col("dist") == depth).select("source", "node", "dist", "sigma", F.lit(0.0).alias("dep"))
    out = level = checkpointed(done)
    for d in range(depth - 1, -1, -1):
        own = reached.where(F.col("dist") == d)
        w = level.select(F.col("source"), F.col("node").alias("dst"), ((1 + F.col("dep")) / F.col("sigma")).alias("share"))
        got = w.join(edges, "dst").select("source", F.col("src").alias("node"), "share").groupBy("source", "node").agg(F.sum("share").alias("share"))
        level = checkpointed(own.join(got, ["source", "node"], "left").select("source", "node", "dist", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("dep")))
        out = out.unionByName(level)
    return checkpointed(out.where("source != node").select("source", "node", "dep"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all endpoints; the component is its least id."""
    roots = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices(edges).join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


#: Edges up to which strong components are found by a depth-first search on the driver, which rounds of joins take a
#: round for each step of the longest path to match.
SMALL = 2_000_000


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component), the component being its least id. Graphs of more than small edges: forward colours to a fixed
    point, then backwards within each colour from its root, and again on what is left."""
    edges = checkpointed(edges.select("src", "dst"))
    if edges.count() <= small:
        g = collected(edges, small)
        of, order = g.strong_components()
        least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(least, of, g.ids)
        return edges.sparkSession.createDataFrame(pa.table([pa.array(g.ids), pa.array(least[of])], names=["id", "component"]))
    left = checkpointed(edges.where("src != dst").select("src", "dst").distinct())
    ids = checkpointed(vertices(edges))
    out = None
    while True:
        colour = ids.withColumn("colour", F.col("id"))
        colour = _least_reaching(left, colour)
        back = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = checkpointed(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("id = colour").select("id")
        found = bfs(back, roots, limit=0).select(F.col("node").alias("id"), F.col("source").alias("component"))
        out = found if out is None else checkpointed(out.unionByName(found))
        ids = checkpointed(ids.join(found.select("id"), "id", "left_anti"))
        if not ids.limit(1).count():
            return out
        keep = ids.select(F.col("id").alias("k"))
        left = checkpointed(left.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi"))


def _least_reaching(edges: DataFrame, colour: DataFrame) -> DataFrame:
    now, changed = checkpointed(colour), None
    while changed != 0:
        sent = edges.join(now.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
        met = now.join(sent, "id", "left").select("id", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.col("colour").alias("was"))
        met = checkpointed(met)
        changed = met.where("colour != was").count()
        now = met.select("id", "colour")
    return now


def condensation(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """Distinct edges between different components."""
    a, b = strong.select(F.col("id").alias("src"), F.col("component").alias("a")), strong.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def pivots(strong: DataFrame, degrees: DataFrame) -> DataFrame:
    """(component, id): the vertex with the most neighbours out and in, ties to the smaller id."""
    met = strong.join(degrees, "id").withColumn("all", F.col("deg") + F.col("indeg"))
    best = met.groupBy("component").agg(F.min_by("id", F.struct((-F.col("all")).alias("k"), "id")).alias("id"))
    return best.select("component", "id")


def eccentricities(edges: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, ecc): the largest finite distance from each source.

    What is joined to one vertex alone, in both directions, is a step farther from everything than that vertex if that
    has other neighbours; so only the latter is searched from.
    """
    e = checkpointed(drop_loops(edges).select("src", "dst").distinct())
    d = checkpointed(degrees_of(e))
    both = e.join(d.where("outs = 1 and ins = 1").select(F.col("id").alias("src")), "src", "left_semi").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    pendant = both.join(d.where("outs > 1").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("hub"))
    asked = checkpointed(sources.select("id").distinct().join(pendant, "id", "left").select("id", F.coalesce("hub", "id").alias("source"), F.col("hub").isNotNull().cast("int").alias("more")))
    far = _summed(e, asked.select(F.col("source").alias("id")), limit)
    return asked.join(far, "source").select("id", (F.col("far") + F.col("more")).alias("ecc"))


def closeness(edges: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, score): (r - 1)^2 / ((n - 1) sum of distances), r the number reached, r = 1 gives 0."""
    n = vertices(edges).agg(F.count("*").alias("n"))
    score = F.when(F.col("total") > 0, (F.col("r") - 1) * (F.col("r") - 1) / ((F.col("n") - 1) * F.col("total"))).otherwise(0.0)
    return _summed(edges, sources, limit).join(F.broadcast(n)).select(F.col("source").alias("id"), score.alias("score"))


def diameter_bound(g: Csr, directed: bool) -> float:
    """An upper bound of the largest finite distance, on a graph that fits the driver.

    Each strong component's pivot has its eccentricities forward and backward within the component; along the
    condensation the forward ones add up. 0 for fewer than two vertices, else 1 at least.
    """
    if g.n < 2:
        return 0.0
    of, order = g.strong_components()  # sinks first
    total = np.diff(g.out_at) + np.diff(g.in_at)
    pivot = np.full(len(order), -1)
    for v in np.lexsort((np.arange(g.n), -total)):
        if pivot[of[v]] < 0:
            pivot[of[v]] = v
    # A component of one vertex has eccentricity 0, so only the others are searched.
    forth, back = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    dist = np.full(g.n, -1)
    for c in np.flatnonzero(np.bincount(of, minlength=len(order)) > 1):
        forth[c] = back[c] = g.eccentricity(pivot[c], of, dist)
        if directed:
            back[c] = g.eccentricity(pivot[c], of, dist, backward=True)
    reach = forth.astype(float)
    src = np.repeat(np.arange(g.n), np.diff(g.out_at))
    pairs = np.unique(np.stack([of[src], of[g.out_to]], 1)[of[src] != of[g.out_to]], axis=0) if len(src) else np.zeros((0, 2), int)
    after: dict[int, list[int]] = {}
    for a, b in pairs.tolist():
        after.setdefault(a, []).append(b)
    for c in range(len(order)):
        for d in after.get(c, ()):
            reach[c] = max(reach[c], forth[c] + 1 + back[d] + reach[d])
    return float(max(1.0, (reach + back).max()))


def landmarks(edges: DataFrame, count: int, mode: str = "ff", seed: int = 42) -> list[int]:
    """Ids chosen by degree, by chance, or farthest first from the vertex of the largest degree."""
    both = checkpointed(symmetrise(edges))
    d = both.groupBy(F.col("src").alias("id")).count()
    if mode == "deg":
        return [r["id"] for r in d.orderBy(F.col("count").desc(), "id").limit(count).collect()]
    if mode == "random":
        return [r["id"] for r in d.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count).collect()]
    chosen = [r["id"] for r in d.orderBy(F.col("count").desc(), "id").limit(1).collect()]
    spark = edges.sparkSession
    near = None
    while chosen and len(chosen) < count:
        got = bfs(both, spark.createDataFrame([(chosen[-1],)], "id long")).select(F.col("node").alias("id"), "dist")
        all_ = d.select("id").join(got, "id", "left").select("id", F.coalesce("dist", F.lit(2**30)).alias("dist"))
        near = checkpointed(all_ if near is None else near.join(all_.withColumnRenamed("dist", "new"), "id").select("id", F.least("dist", "new").alias("dist")))
        far = near.orderBy(F.col("dist").desc(), "id").first()
        if far is None or far["dist"] == 0:
            break
        chosen.append(far["id"])
    return chosen


def landmark_distances(edges: DataFrame, ids: list[int]) -> DataFrame:
    """(id, landmark, value): log1p of distances on the symmetrised graph; out of reach counts twice the farthest."""
    both = symmetrise(edges)
    marks = edges.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    got = checkpointed(bfs(both, marks).select(F.col("source").alias("landmark"), F.col("node").alias("id"), "dist"))
    far = got.agg(F.max("dist")).first()[0] or 0
    grid = vertices(both).join(F.broadcast(marks.withColumnRenamed("id", "landmark")))  # a few landmarks
    return grid.join(got, ["id", "landmark"], "left").select("id", "landmark", F.log1p(F.coalesce("dist", F.lit(2 * far)).cast("double")).alias("value"))


def landmark_stats(distances: DataFrame) -> DataFrame:
    """(id, least, most, mean) of landmark_distances(), each landmark's column first divided by its maximum plus 1e-6."""
    top = distances.groupBy("landmark").agg((F.max("value") + 1e-6).alias("top"))
    share = distances.join(F.broadcast(top), "landmark").select("id", (F.col("value") / F.col("top")).alias("value"))  # a few landmarks
    return share.groupBy("id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
