"""Consecutive numbers in a given order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed


def running_total(rows: DataFrame, order: list[Column], value: str, name: str = "total") -> DataFrame:
    """rows with the sum of value (whole numbers) over all rows up to each one in order, itself included."""
    window = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _offset(rows, order, F.sum(value), F.sum(value).over(window), name)


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with the place of each row in order, from 0. Rows must differ in order for a repeatable result."""
    return _offset(rows, order, F.count("*"), F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1, name)


def _offset(rows: DataFrame, order: list[Column], size: Column, place: Column, name: str) -> DataFrame:
    """Ranges are sorted apart, and what is counted in each goes on from the ranges before it. Only one number for each
    partition reaches the driver; they are joined back as a table."""
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(size.cast("long").alias("n")).collect()):
        before.append((part, total))
        total += n or 0
    offsets = rows.sparkSession.createDataFrame(before, "__offset_part int, __offset long")
    met = ranged.withColumn(name, place).join(F.broadcast(offsets), F.col("__part") == F.col("__offset_part"))
    return met.withColumn(name, (F.col(name) + F.col("__offset")).cast("long")).drop("__part", "__offset_part", "__offset")
