"""Registered queries on text formats: a table is written to the shared folder by a sink and read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centra.functions.storage import ROWS, checkpointed, shared_dir
from centra.operators import algebra, graph
from centra.sources import sinks, tables, text

QUERIES = {}
ORACLE = {}

UN = "un as (select distinct src, dst from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events) where dst is not null and src != dst)"
SP = "p as (select distinct 2 * l_suppkey as src, 2 * l_partkey + 1 as dst from lineitem)"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def query(sql: str):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, folder(spark, name))
        ORACLE[name] = sql
        return f

    return add


def _say(rows: DataFrame, path: str, order: str | None = None) -> str:
    """Lines(value), in one part if their order counts; they are ordered in ranges before one task writes them."""
    if order is not None:
        rows = checkpointed(rows)
        ranges = max(1, -(-rows.count() // ROWS))
        rows = checkpointed(rows.repartitionByRange(ranges, order).sortWithinPartitions(order).select("value")).coalesce(1)
    rows.select("value").write.text(path)
    return path


@query(f"with {UN} select src, dst from un")
def file_edges(spark, sf_dir, path):
    """Space-separated lines with a comment and fields to skip."""
    sinks.write_edges(tables.next_user(spark, sf_dir), path)
    extra = spark.createDataFrame([("# a comment",), ("% another",), ("",), ("x y",)], "value string")
    _say(spark.read.text(path).withColumn("value", F.concat("value", F.lit(" 7"))).unionByName(extra), f"{path}-more")
    return text.read_edges(spark, f"{path}-more")


@query(f"with {SP} select src, dst from p union select dst, src from p")
def file_edges_once(spark, sf_dir, path):
    """Each undirected edge stands in the file once, separated by commas."""
    sinks.write_edges(tables.supplier_part(spark, sf_dir), path, separator=",", once=True)
    return text.read_edges(spark, path, directed=False)


@query(f"with {UN}, low as (select min(least(src, dst)) as low from un) select src - low + 1 as src, dst - low + 1 as dst from un, low")
def file_edges_one_based(spark, sf_dir, path):
    """Ids written from 0 on are read from 1 on."""
    edges = tables.next_user(spark, sf_dir)
    sinks.write_edges(edges, path, base=edges.agg(F.min(F.least("src", "dst"))).first()[0])
    return text.read_edges(spark, path, shift=True)


@query(f"""with {UN}, line as (select src, dst, row_number() over (order by dst, src) as n from un), seen as (select src as id, 2 * n as pos from line union all select dst, 2 * n + 1 from line),
num as (select id, row_number() over (order by min(pos)) - 1 as n from seen group by id) select a.n as src, b.n as dst from un join num a on a.id = src join num b on b.id = dst""")
def file_edges_relabelled(spark, sf_dir, path):
    """Ids are numbered as they first appear in the lines."""
    rows = tables.next_user(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value"), F.struct("dst", "src").alias("at"))
    return text.read_edges_relabelled(spark, _say(rows, path, "at"))[0]


@query("select 'line ' || event_id as value from events where event_id % 3 = 0")
def file_bad_lines(spark, sf_dir, path):
    """Lines that no edge list may hold are listed."""
    rows = tables.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("line "), "event_id")).otherwise(F.concat_ws(" ", "event_id", "user_id")).alias("value"))
    return text.bad_lines(spark, _say(rows, path))


@query("select 'graphs/' || n_name || '.txt' as path, n_regionkey % 2 = 0 as directed from nation")
def file_instances(spark, sf_dir, path):
    """A manifest with a comment."""
    rows = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("graphs/"), "n_name", F.lit(".txt "), F.when(F.col("n_regionkey") % 2 == 0, "D").otherwise("U")).alias("value"))
    return text.read_instances(spark, _say(rows.unionByName(spark.createDataFrame([("# instances",)], "value string")), path))


@query("with low as (select min(s_suppkey) = 0 as zero from supplier) select s_suppkey + zero::int as id, s_acctbal as score from supplier, low")
def file_truth(spark, sf_dir, path):
    """node,betweenness, shifted if the least id is 0."""
    tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("betweenness")).write.csv(path, header=True)
    return text.read_truth(spark, path)


@query("select row_number() over (order by c_custkey) - 1 as id, c_acctbal as score from customer")
def file_score_lines(spark, sf_dir, path):
    """A line's number is its vertex."""
    return text.read_score_lines(spark, _say(tables.table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("string").alias("value"), "c_custkey"), path, "c_custkey"))


@query("select c_custkey as id, c_acctbal as score, kind from customer, (values ('plain'), ('csv'), ('colon')) t(kind) where c_custkey < 1000")
def file_tool_scores(spark, sf_dir, path):
    """Score lines in three layouts; ids from 1000 on are out of range."""
    own, out = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("i"), F.col("c_acctbal").cast("string").alias("x")), None
    for kind, between in (("plain", " "), ("csv", ","), ("colon", " : ")):
        lines = spark.read.text(_say(own.select(F.concat_ws(between, "i", "x").alias("value")), f"{path}-{kind}"))
        got = text.parse_scores(lines, kind, 1000).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


@query("select row_number() over (order by p_retailprice desc, p_partkey)::int as rank, p_partkey as id, p_retailprice - 1 as lower, p_retailprice as score, p_retailprice + 1 as upper, p_partkey % 2 = 0 as unresolved from part")
def file_ranked(spark, sf_dir, path):
    """Lines 'rank) node lower estimate upper', some marked as unresolved."""
    from centra.functions.numbering import numbered

    rows = numbered(tables.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")])
    mark = F.when(F.col("p_partkey") % 2 == 0, "? ").otherwise("")
    said = F.concat(mark, (F.col("n") + 1).cast("string"), F.lit(") "), F.concat_ws(" ", "p_partkey", F.col("p_retailprice") - 1, "p_retailprice", F.col("p_retailprice") + 1))
    got = text.parse_ranked(spark.read.text(_say(rows.select(said.alias("value")), path)))
    return got.select("rank", "id", *(F.round(c, 6).alias(c) for c in ("lower", "score", "upper")), "unresolved")


@query("select count(*) as runs, round(sum(o_totalprice), 2) as seconds, sum(o_orderkey % 100) as samples, count(distinct o_orderstatus) as algorithms, sum((o_custkey % 2 = 0)::int) as directed from orders")
def file_runs(spark, sf_dir, path):
    """Run objects, one a line, without their centralities."""
    o = tables.table(spark, sf_dir, "orders")
    run = o.select(
        F.struct(F.col("o_orderstatus").alias("algorithm"), (F.col("o_custkey") % 2 == 0).alias("directed")).alias("parameters"), F.col("o_totalprice").alias("execution_time_seconds"),
        (F.col("o_orderkey") % 100).alias("num_samples"), F.create_map(F.lit("1"), F.lit(0.5)).alias("centralities"),
    )
    sinks.write_runs(run, path, scores=False)
    back = text.read_runs(spark, path, lines=True).where("centralities is null")
    return back.agg(F.count("*").alias("runs"), F.round(F.sum("execution_time_seconds"), 2).alias("seconds"), F.sum("num_samples").alias("samples"),
                    F.count_distinct("parameters.algorithm").alias("algorithms"), F.sum(F.col("parameters.directed").cast("long")).alias("directed"))


@query("""with e as (select event_id, user_id, event_type, row_number() over (order by event_id) - 1 as line from events), h as (select *, last_value(case when event_id % 50 = 0 then user_id end ignore nulls) over (order by line) as seed from e)
select seed::varchar as seed, event_type as graph, min_by(user_id, line)::varchar as tau from h where event_id % 50 != 0 group by all""")
def file_log(spark, sf_dir, path):
    """Results under the last seed line before them; the first of several for one graph counts."""
    e = tables.table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("seed : "), "user_id")).otherwise(F.concat(F.lit("graph "), "event_type", F.lit(" tau "), "user_id"))
    lines = text.numbered_lines(spark, _say(e.select(said.alias("value"), "event_id"), path, "event_id")).withColumn("log", F.lit("one"))
    return text.parse_log(lines, r"graph (\w+) tau ([.\d]+)", ["graph", "tau"]).select("seed", "graph", "tau")


@query("select max_by(user_id, event_id) filter (event_type = 'purchase')::varchar as purchase, max_by(user_id, event_id) filter (event_type = 'click')::varchar as click from events")
def file_last_values(spark, sf_dir, path):
    """What follows a prefix in its last line."""
    rows = tables.table(spark, sf_dir, "events").select(F.concat_ws(": ", "event_type", F.col("user_id").cast("string")).alias("value"), "event_id")
    lines = text.numbered_lines(spark, _say(rows, path, "event_id")).withColumn("log", F.lit("one"))
    return text.last_values(lines, ["purchase:", "click:"]).select("purchase", "click")


@query("select o_orderpriority as algorithm, null::int as seed, o_orderstatus as graph, round(avg(o_totalprice), 4) as value from orders group by all")
def file_wide_results(spark, sf_dir, path):
    """One column for each graph, and back to rows."""
    long = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("graph")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    sinks.wide_results(long.withColumn("metric", F.lit("mean")), ["F", "O", "P"]).drop("metric").coalesce(1).write.csv(path, header=True)
    return text.read_wide_results(spark, path)


@query("select c_mktsegment as graph, max(c_custkey) as nodes, max_by(c_nationkey::bigint, c_custkey) as edges, max_by(c_acctbal, c_custkey) as seconds, max_by((c_custkey % 3)::varchar, c_custkey) as status from customer group by all")
def file_timings(spark, sf_dir, path):
    """The last row of a graph counts."""
    c = tables.table(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1)
    rows = c.select(F.col("c_mktsegment").alias("Dataset"), F.col("c_custkey").alias("Nodes"), F.col("c_nationkey").alias("Edges"), F.col("c_acctbal").alias("Runtime_s"), (F.col("c_custkey") % 3).cast("string").alias("Status"))
    rows.write.csv(path, header=True)
    return text.read_timings(spark, path)


@query(f"with {UN}, ids as (select src as id from un union select dst from un) select id as node_id, coalesce(s.score, 0.0) as betweenness from ids left join (select src as id, count(*)::double as score from un group by src having count(*) > 50) s using (id)")
def file_training_instance(spark, sf_dir, path):
    """Vertices without a score get 0."""
    e = tables.next_user(spark, sf_dir)
    some = algebra.degrees(e).where("deg > 50").select("id", F.col("deg").cast("double").alias("score"))
    sinks.write_training_instance(e, graph.vertices(e), some, path)
    return spark.read.csv(f"{path}/scores", header=True, schema="node_id long, betweenness double")


@query(f"""with {UN}, ids as (select src as id from un union select dst from un)
select id, (select count(*) from un where src = id)::double as truth, (select count(*) from un where dst = id)::double as pred, (select count(*) from un where dst = id) as in_deg, (select count(*) from un where src = id) as out_deg from ids""")
def file_predictions(spark, sf_dir, path):
    d = algebra.degrees(tables.next_user(spark, sf_dir))
    score = lambda c: d.select("id", F.col(c).cast("double").alias("score"))
    sinks.predictions(score("deg"), score("indeg"), d).write.parquet(path)
    return spark.read.parquet(path)


@query("select '| ' || n_name || ' | ' || n_regionkey || ' | ' || printf('%.2f', n_nationkey / 3.0) || ' |' as value from nation union all select '| name | region | share |' union all select '|-|-|-|'")
def table_markdown(spark, sf_dir, path):
    rows = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") / 3.0).alias("share"))
    return sinks.markdown(rows, 2, header=True)


@query("select replace(n_name, '_', '\\_') || ' & ' || n_regionkey || ' & ' || printf('%.2f', n_nationkey / 3.0) || ' \\\\' as value from nation union all select 'name & region & share \\\\ \\midrule'")
def table_latex(spark, sf_dir, path):
    rows = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") / 3.0).alias("share"))
    return sinks.latex(rows, 2)


@query("select s_suppkey as id, s_acctbal as score from supplier where s_acctbal > 0 union all select s_suppkey, 0.0 from supplier where s_acctbal <= 0")
def file_zero_filled(spark, sf_dir, path):
    """Truth is filled up with 0 on the ids of a graph."""
    s = tables.table(spark, sf_dir, "supplier")
    s.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("a"), F.col("s_acctbal").cast("string").alias("b")).select(F.concat_ws(",", "a", "b").alias("value")).write.text(path)
    return text.zero_filled(s.select(F.col("s_suppkey").alias("id")), text.parse_scores(spark.read.text(path), "csv"))
