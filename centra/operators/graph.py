"""Edge tables (src, dst) and what normalises them. Undirected graphs hold both directions of each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.functions.numbering import numbered
from centra.functions.storage import checkpointed


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src != dst")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(transpose(edges)).distinct()


def one_sided(edges: DataFrame) -> DataFrame:
    """Edges without their reverse; an undirected graph has none."""
    return edges.join(transpose(edges), ["src", "dst"], "left_anti")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over 0..n-1 in the order of the old ids, and the map (id, n). Isolates have no edge and so no number."""
    map_ = numbered(vertices(edges), [F.col("id")])
    a = map_.select(F.col("id").alias("src"), F.col("n").alias("a"))
    b = map_.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), map_


def relabel_first_seen(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for lines(line, src, dst) in the order in which ids first appear, src before dst in a line."""
    seen = lines.select(F.explode(F.array(F.struct((F.col("line") * 2).alias("at"), F.col("src").alias("id")), F.struct((F.col("line") * 2 + 1).alias("at"), F.col("dst").alias("id")))).alias("x"))
    first = seen.groupBy("x.id").agg(F.min("x.at").alias("at"))
    map_ = numbered(first, [F.col("at")]).select("id", "n")
    a = map_.select(F.col("id").alias("src"), F.col("n").alias("a"))
    b = map_.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    return lines.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), map_


def one_based(edges: DataFrame) -> DataFrame:
    """Ids moved up by one if the least is 0."""
    shift = edges.agg((F.min(F.least("src", "dst")) == 0).cast("long").alias("shift"))
    return edges.join(F.broadcast(shift)).select((F.col("src") + F.col("shift")).alias("src"), (F.col("dst") + F.col("shift")).alias("dst"))


def keep_rows(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """D A: the edges that leave a vertex of kept(id)."""
    return edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


def keep_columns(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """A D: the edges that enter one."""
    return edges.join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def between(edges: DataFrame) -> DataFrame:
    """(id) of vertices that may lie inside a shortest path: some in-neighbour u and out-neighbour w, u other than w,
    have no edge u -> w. All other vertices (leaves, sources, sinks and those in the midst of cliques) are masked."""
    # A vertex is settled without its wedges if an in-neighbour has too few out-neighbours for all of its, or an
    # out-neighbour too few in-neighbours. What is left is expanded along edges whose far side has no fewer, so wedges
    # number edges times the root of edges at most, however large a hub is.
    e = checkpointed(drop_loops(edges).select("src", "dst").distinct())
    d = degrees_of(e)
    far = lambda c: d.select(F.col("id").alias(c), F.col("outs").alias(f"{c}_outs"), F.col("ins").alias(f"{c}_ins"))
    rev = transpose(e).withColumn("both", F.lit(1))
    met = checkpointed(e.join(rev, ["src", "dst"], "left").join(far("src"), "src").join(far("dst"), "dst").withColumn("both", F.coalesce("both", F.lit(0))))
    by_in = met.where((F.col("dst_outs") > F.col("both")) & (F.col("src_outs") < F.col("dst_outs") - F.col("both") + 1)).select(F.col("dst").alias("id"))
    by_out = met.where((F.col("src_ins") > F.col("both")) & (F.col("dst_ins") < F.col("src_ins") - F.col("both") + 1)).select(F.col("src").alias("id"))
    open_ = checkpointed(by_in.unionByName(by_out).distinct())
    rest = d.where("ins > 0 and outs > 0").select("id").join(open_, "id", "left_anti")
    into = e.select(F.col("src").alias("u"), F.col("dst").alias("id")).join(rest, "id")
    wedges = into.join(e.select(F.col("src").alias("id"), F.col("dst").alias("w")), "id").where("u != w")
    found = wedges.join(e.select(F.col("src").alias("u"), F.col("dst").alias("w")), ["u", "w"], "left_anti").select("id").distinct()
    return open_.unionByName(found)


def degrees_of(edges: DataFrame) -> DataFrame:
    """(id, outs, ins) of all endpoints."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").alias("outs"), F.sum("x.i").alias("ins"))


def clique_mask(edges: DataFrame) -> DataFrame:
    """(id, mask) with 1 for vertices of between()."""
    return vertices(edges).join(between(edges).withColumn("mask", F.lit(1)), "id", "left").select("id", F.coalesce("mask", F.lit(0)).alias("mask"))


def leaf_mask(scores: DataFrame, degrees: DataFrame, eps: float = 1e-6) -> DataFrame:
    """scores(id, score) with the vertices of one neighbour at most put below all others."""
    least = scores.agg(F.min("score").alias("least"))
    leaf = degrees.select("id", (F.col("deg") < 2).alias("leaf"))
    met = scores.join(leaf, "id", "left").join(F.broadcast(least))
    return met.select("id", F.when(F.coalesce("leaf", F.lit(True)), F.col("least") - eps).otherwise(F.col("score")).alias("score"))


def uniform(seed: int, *by: str) -> Column:
    """A number in [0, 1) that hangs on seed and columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) / float(1 << 52)


def orient(edges: DataFrame, seed: int = 0) -> DataFrame:
    """One direction of each undirected edge, by a coin."""
    once = edges.where("src < dst")
    heads = uniform(seed, "src", "dst") < 0.5
    return once.select(F.when(heads, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(heads, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def permutation(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(id, n): a random order of ids(id)."""
    return numbered(ids.withColumn("__r", F.xxhash64(F.lit(seed), "id")), [F.col("__r"), F.col("id")]).select("id", "n")


def drop_edges(edges: DataFrame, degrees: DataFrame, share: float, seed: int = 0, least: int = 5) -> DataFrame:
    """Undirected edges but for a random share; those at a vertex with fewer than least neighbours all stay."""
    d = lambda c: degrees.select(F.col("id").alias(c), F.col("deg").alias(f"deg_{c}"))
    once = edges.where("src < dst").join(d("src"), "src").join(d("dst"), "dst")
    kept = once.where((uniform(seed, "src", "dst") >= share) | (F.least("deg_src", "deg_dst") < least))
    return symmetrise(kept.select("src", "dst"))


def line_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices are the undirected edges (n, src, dst); two are joined if they share an endpoint, of which different edges
    have one at most: so no pair comes twice, and pairs, whose number is quadratic in degrees, stream from the join."""
    named = numbered(edges.where("src < dst").select("src", "dst").distinct(), [F.col("src"), F.col("dst")])
    ends = named.select("n", F.explode(F.array("src", "dst")).alias("v"))
    pairs = ends.select(F.col("n").alias("src"), "v").join(ends.select(F.col("n").alias("dst"), "v"), "v").where("src != dst")
    return pairs.select("src", "dst"), named.select("n", "src", "dst")


def top_mask(scores: DataFrame, k: int) -> DataFrame:
    """(id, mask): 1.0 for the k largest scores, ties to smaller ids."""
    top = scores.orderBy(F.col("score").desc(), "id").limit(k).select("id", F.lit(1.0).alias("mask"))
    return scores.select("id").join(top, "id", "left").select("id", F.coalesce("mask", F.lit(0.0)).alias("mask"))


def scale(n: int, mode: str = "graphs", directed: bool = True) -> float:
    """What turns the share of ordered pairs into the wanted convention."""
    if mode == "graphs":
        return n * (n - 1) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if mode == "none":
        return n * (n - 1) / (1 if directed else 2)
    if mode == "pairs":
        return 1.0
    raise ValueError(f"unknown normalisation {mode!r}")


def summary(edges: DataFrame) -> DataFrame:
    """One row: n endpoints, m edges, m / n."""
    n = vertices(edges).agg(F.count("*").alias("n"))
    return edges.agg(F.count("*").alias("m")).join(F.broadcast(n)).select("n", "m", (F.col("m") / F.col("n")).alias("density"))
