"""Connected components by alternating large-star and small-star rounds over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions.storage import checkpointed


def _least(pairs: DataFrame) -> DataFrame:
    """For each a of pairs(a, b) the least of its own id and all its b."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges(a, b); root is the least node that can be reached.

    Both columns are of one orderable type; loops, repeats and nulls are dropped. Each round keeps at most as many
    edges as before, rounds are logarithmic in the diameter, and minima are pre-aggregated before each shuffle.
    """
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(_least(both), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _least(down)
        small = down.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        small = small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")).where("a != b")).distinct()
        now = checkpointed(small)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sign
