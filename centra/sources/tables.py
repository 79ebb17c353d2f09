"""Graphs that are derived from business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.functions.numbering import numbered
from centra.functions.storage import dealt
from centra.operators.graph import drop_loops, symmetrise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both_ways(pairs: DataFrame, rows: int) -> DataFrame:
    """Distinct edges in both directions of pairs(src, dst) whose ends come from different ids, of some rows.

    Nearly all pairs differ, so they are dealt out before repeats are dropped, over as many tasks as bound the memory of
    each. As no reverse of a pair is one itself, but for a pair of nulls, both directions come without another shuffle.
    """
    once = dealt(pairs, rows, "src", "dst").distinct()
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = F.when(F.col("src").isNull() & F.col("dst").isNull(), F.slice(ends, 1, 1)).otherwise(ends)
    return once.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between suppliers (even ids) and parts (odd ids) of order lines."""
    lines = table(spark, sf_dir, "lineitem")
    return _both_ways(lines.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")), lines.count())


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between customers (even ids) and suppliers (odd ids) of order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.count()
    of = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    met = dealt(lines, rows, "l_orderkey").join(dealt(of, rows, "l_orderkey"), "l_orderkey")
    return _both_ways(met.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")), rows)


def next_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges from the user of an event to the user of the next one in time."""
    line = numbered(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), [F.col("ts"), F.col("event_id")])
    after = line.select((F.col("n") - 1).alias("n"), F.col("user_id").alias("dst"))
    return drop_loops(line.join(after, "n").select(F.col("user_id").alias("src"), "dst")).distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An undirected forest: suppliers (ids 0 modulo 3) below their nations (1) below their regions (2)."""
    up = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("src"), (F.col("s_nationkey") * 3 + 1).alias("dst"))
    top = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3 + 1).alias("src"), (F.col("n_regionkey") * 3 + 2).alias("dst"))
    return symmetrise(up.unionByName(top))


def last_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges from each customer to the customer of the order that comes next after its last one."""
    line = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")])
    last = line.groupBy(F.col("o_custkey").alias("src")).agg((F.max("n") + 1).alias("n"))
    return drop_loops(last.join(line.select("n", F.col("o_custkey").alias("dst")), "n").select("src", "dst"))
