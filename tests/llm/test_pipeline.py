"""The pipeline stage by stage, and the SQL of the operators that have some."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from centra.llm import queries


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
    assert 0 < docs.count() <= 3 * n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and {"doc_id", "n_tokens"} <= set(last.columns)


def test_all_registered(spark, sf_dir):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    said = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, said.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())
