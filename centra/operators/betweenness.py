"""Exact betweenness: a kernel over a broadcast graph, and joins for graphs that are too large for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed

from .csr import LIMIT, collected
from .graph import vertices
from .traverse import bfs, dependencies

#: Sources that the joins treat at once.
SOURCES = 256


def betweenness(edges: DataFrame, endpoints: bool = False, limit: int = LIMIT) -> DataFrame:
    """(id, score): the sum over ordered pairs s, t of the share of shortest paths that pass through id.

    On undirected graphs each pair counts twice; operators.graph.scale names the conventions. Sources are dealt over
    tasks, each task adds up its own, and partial sums meet in one pre-aggregated shuffle.
    """
    edges = checkpointed(edges.select("src", "dst"))
    if edges.count() > limit:
        return betweenness_by_joins(edges, limit=limit)
    parts = _added_up(edges, None, endpoints, limit)
    return vertices(edges).join(parts, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _added_up(edges: DataFrame, sources: DataFrame | None, endpoints: bool, limit: int) -> DataFrame:
    """(id, score) above 0 by the kernel, from sources(id) or all vertices."""
    spark = edges.sparkSession
    g = collected(edges, limit)
    sent, every = spark.sparkContext.broadcast(g), sources is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.n)
        for batch in batches:
            own = batch.column(0).to_numpy()
            own = own if every else sent.value.places(own)
            for s in own[own >= 0].tolist():
                total += sent.value.dependency(s, endpoints)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value.ids[some]), pa.array(total[some])], names=["id", "part"])

    tasks = max(1, min(g.n, 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.range(0, g.n, 1, tasks) if every else sources.select("id").repartition(tasks, "id")
    return dealt.mapInArrow(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("score"))


def betweenness_by_joins(edges: DataFrame, sources: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """The same from breadth-first searches by joins, some sources at a time; sources(id) stand for all if given.

    Each search of a round joins all edges, so more sources than a round takes walk a broadcast graph of up to limit edges.
    """
    edges = checkpointed(edges.select("src", "dst"))
    ids = vertices(edges)
    chosen = checkpointed((ids if sources is None else sources).select("id").distinct())
    rounds = -(-chosen.count() // SOURCES)
    if rounds > 1 and edges.count() <= limit:
        summed = _added_up(edges, chosen, False, limit)
        return ids.join(summed, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    total = None
    for r in range(rounds):
        own = chosen.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
        dep = dependencies(edges, bfs(edges, own, limit=0)).groupBy(F.col("node").alias("id")).agg(F.sum("dep").alias("score"))
        # Rounds add up as they go: one plan over all of them would hold each round's tables.
        total = checkpointed(dep if total is None else total.unionByName(dep).groupBy("id").agg(F.sum("score").alias("score")))
    if total is None:
        return ids.withColumn("score", F.lit(0.0))
    return ids.join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
