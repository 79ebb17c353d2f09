"""The corpus pipeline: language ID, near-duplicates, repeated substrings, mixing, encoding.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from centra.llm import bpe, language_id, mixing, simhash, substrings
from centra.llm.common import delete, durable, recorded

STAGES = [
    ("language_id", language_id.stage),
    ("simhash", simhash.stage),
    ("suffix_array", substrings.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: Learned models, hashes and byte pair merges have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables and its predecessor go once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with recorded() as own:
            docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, last + own[:-1])
        last = own[-1:]
    return docs
