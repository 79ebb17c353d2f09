"""The cluster's shared folder, and cutting lineage through it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, from spark.checkpoint.dir. Where that is unset, a temporary one in local mode
    (tests); on a cluster an error, as executors would each write to a folder of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="centra-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


#: Rows that a task sorts or aggregates at once where tables are dealt out by their size.
ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by hash of some columns over as many tasks as its number of rows needs. Partitions that Spark sizes by their
    bytes hold more rows the larger the table is, up to some 64 MB that are compressed."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *by)


def spread(df: DataFrame, rows: int, by: str) -> DataFrame:
    """The same before a join, where Spark would deal both sides anew unless there are as many parts as it makes itself;
    small tables are left to it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS)), by) if rows > 16 * ROWS else df


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for the tables of iterations; Spark's cleaner removes the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
