"""Registered queries and their SQL. Numbers with rounding error are rounded alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centra.functions import ranking
from centra.operators import algebra, generators, gnn, graph, sampling, traverse
from centra.operators.betweenness import betweenness, betweenness_by_joins
from centra.operators.csr import collected
from centra.plans import files, runlog
from centra.sources import tables

QUERIES = {}
ORACLE = {}

GRAPHS = {
    "sp": """sp as materialized (with p as (select distinct 2 * l_suppkey as a, 2 * l_partkey + 1 as b from lineitem) select a as src, b as dst from p union select b, a from p)""",
    "cs": """cs as materialized (with p as (select distinct 2 * o_custkey as a, 2 * l_suppkey + 1 as b from lineitem join orders on l_orderkey = o_orderkey) select a as src, b as dst from p union select b, a from p)""",
    "un": """un as materialized (select distinct src, dst from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events) where dst is not null and src != dst)""",
    "geo": """geo as materialized (with p as (select 3 * s_suppkey as a, 3 * s_nationkey + 1 as b from supplier union select 3 * n_nationkey + 1, 3 * n_regionkey + 2 from nation) select a as src, b as dst from p union select b, a from p)""",
    "lc": """lc as materialized (select src, dst from (select o_custkey as src, lead(o_custkey) over (order by o_orderkey) as dst, row_number() over (partition by o_custkey order by o_orderkey desc) as back from orders) where back = 1 and src != dst)""",
}
BUILD = {"sp": tables.supplier_part, "cs": tables.customer_supplier, "un": tables.next_user, "geo": tables.places, "lc": tables.last_customer}


def edges(spark, sf_dir: str, name: str) -> DataFrame:
    return BUILD[name](spark, sf_dir)


def query(graph_name: str | None = None, sql: str | None = None, name: str | None = None):
    """Registers f(edges) on a derived graph of all rows, or f(spark, sf_dir); sql is put after the graph's common table."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = (lambda spark, sf_dir: f(edges(spark, sf_dir, graph_name))) if graph_name else f
        if sql:
            ORACLE[key] = f"with recursive {GRAPHS[graph_name]}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if graph_name else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


for _g in GRAPHS:
    query(_g, f"select src, dst from {_g}", f"edges_{_g}")(lambda e: e)

query("un", "select src, dst from un union select dst, src from un", "symmetrise")(graph.symmetrise)
query("un", "select dst as src, src as dst from un", "transpose")(graph.transpose)
query("un", "select src, dst from un where not exists (select 1 from un o where o.src = un.dst and o.dst = un.src)", "one_sided")(graph.one_sided)
query("cs", "select count(distinct src) as n, count(*) as m, round(count(*) / count(distinct src), 6) as density from cs", "graph_summary")(lambda e: rounded(graph.summary(e)))
query("un", """+ids as (select src as id from un union select dst from un), num as (select id, row_number() over (order by id) - 1 as n from ids)
select a.n as src, b.n as dst from un join num a on a.id = src join num b on b.id = dst""", "relabel")(lambda e: graph.relabel(e)[0])

_MASK = """+kept as (select distinct i.dst as id from {g} i join {g} o on i.dst = o.src and i.src != o.dst
  where not exists (select 1 from {g} c where c.src = i.src and c.dst = o.dst)), ids as (select src as id from {g} union select dst from {g})"""
query("lc", _MASK.format(g="lc") + " select id, (id in (select id from kept))::int as mask from ids", "clique_mask_directed")(graph.clique_mask)
query("geo", _MASK.format(g="geo") + " select id, (id in (select id from kept))::int as mask from ids", "clique_mask")(graph.clique_mask)
query("lc", _MASK.format(g="lc") + " select src, dst from lc where src in (select id from kept)", "row_mask")(lambda e: graph.keep_rows(e, graph.between(e)))
query("lc", _MASK.format(g="lc") + " select src, dst from lc where dst in (select id from kept)", "column_mask")(lambda e: graph.keep_columns(e, graph.between(e)))
query("geo", """+num as (select src, dst, row_number() over (order by src, dst) - 1 as n from geo where src < dst), ends as (select n, src as v from num union all select n, dst from num)
select distinct a.n as src, b.n as dst from ends a join ends b on a.v = b.v and a.n != b.n""", "line_graph")(lambda e: graph.line_graph(e)[0])
_DEG = "+ids as (select src as id from {g} union select dst from {g}), d as (select id, (select count(*) from {g} where src = id) as deg, (select count(*) from {g} where dst = id) as indeg from ids)"
query("un", _DEG.format(g="un") + " select id, deg, indeg from d", "degrees")(algebra.degrees)
query("un", _DEG.format(g="un") + " select id, round(deg / ((select count(*) from ids) - 1), 6) as score from d", "degree_centrality")(lambda e: rounded(algebra.degree_centrality(e)))
query("sp", _DEG.format(g="sp") + " select id, round(case when deg < 2 then 1 - 1e-6 else deg end, 6) as score from d", "leaf_mask")(
    lambda e: rounded(graph.leaf_mask(algebra.degrees(e).select("id", F.col("deg").cast("double").alias("score")), algebra.degrees(e))))
query("sp", _DEG.format(g="sp") + " select id, (row_number() over (order by deg desc, id) <= 25)::double as mask from d", "top_mask")(
    lambda e: graph.top_mask(algebra.degrees(e).select("id", F.col("deg").alias("score")), 25))


def _steps(g: str, m: int) -> str:
    out = f"+ids as (select src as id from {g} union select dst from {g}), d0 as (select id, 1.0::double as v from ids)"
    for k in range(1, m + 1):
        out += f", d{k} as materialized (select ids.id, coalesce(sum(p.v), 0)::double as v from ids left join {g} on src = ids.id left join d{k - 1} p on p.id = dst group by ids.id)"
    return out


query("un", _steps("un", 3) + " select id, round(ln(1 + d1.v), 6) as mass1, round(ln(1 + d1.v + d2.v), 6) as mass2, round(ln(1 + d1.v + d2.v + d3.v), 6) as mass3 from d1 join d2 using (id) join d3 using (id)", "degree_masses")(lambda e: rounded(algebra.degree_masses(e, 3)))
query("sp", _steps("sp", 3) + " select id, round(d1.v + d2.v + d3.v, 6) as score from d1 join d2 using (id) join d3 using (id)", "degree_mass_score")(lambda e: rounded(algebra.degree_mass_score(e, 2, False)))
query("sp", _steps("sp", 1) + """, m2 as (select ids.id, coalesce(max(v), 0) as v from ids left join sp on src = ids.id left join d1 on d1.id = dst group by ids.id),
m3 as (select ids.id, coalesce(max(m2.v), 0) as v from ids left join sp on src = ids.id left join m2 on m2.id = dst group by ids.id)
select d1.id, round(ln(1 + d1.v), 6) as c1, round(ln(1 + m2.v), 6) as c2, round(ln(1 + m3.v), 6) as c3 from d1 join m2 using (id) join m3 using (id)""", "neighbour_maximum")(lambda e: rounded(algebra.features(e, "degree_mix_max")))  # fmt: skip
query("un", _steps("un", 3) + " select d1.id, round(ln(1 + d1.v), 6) as c1, round(ln(1 + d2.v), 6) as c2, round(ln(1 + d3.v), 6) as c3 from d1 join d2 using (id) join d3 using (id)", "feature_mix_sum")(lambda e: rounded(algebra.features(e, "degree_mix_sum")))
query("un", _steps("un", 3) + " select d1.id, round(ln(1 + d1.v), 6) as c1, round(ln(1 + d1.v + d2.v + d3.v), 6) as c2 from d1 join d2 using (id) join d3 using (id)", "feature_mix_d0d2")(lambda e: rounded(algebra.features(e, "degree_mix_d0d2")))
query("un", _steps("un", 2) + ", f as (select d1.id, ln(1 + d1.v) as a, ln(1 + d2.v) as b from d1 join d2 using (id)) select id, round(a / ((select max(a) from f) + 1e-6), 6) as c1, round(b / ((select max(b) from f) + 1e-6), 6) as c2 from f", "feature_normalised")(
    lambda e: rounded(algebra.features(e, "degree_mix_sum_2", normalised=True)))
query("un", _steps("un", 1) + " select id, " + ", ".join(f"round({'sin' if i % 2 == 0 else 'cos'}(v / pow(10000, {2 * (i // 2)} / 6.0)), 6) as c{i + 1}" for i in range(6)) + " from d1", "feature_encoding")(lambda e: rounded(algebra.features(e, "positional_encoding", width=6)))


def _evmass(g: str) -> str:
    out = f"+ids as (select src as id from {g} union select dst from {g}), deg as (select ids.id, count({g}.src) as k from ids left join {g} on src = ids.id group by ids.id), e0 as (select id, 1.0 / (select count(*) from ids) as v from ids)"
    for k in range(1, 6):
        out += f", s{k} as materialized (select ids.id, coalesce(sum(p.v), 0) as v from ids left join {g} on src = ids.id left join e{k - 1} p on p.id = dst group by ids.id), e{k} as materialized (select id, v / ((select sqrt(sum(v * v)) from s{k}) + 1e-8) as v from s{k})"
    out += ", h0 as (select id, v * (select count(*) from ids) / (k + 1) as v from e5 join deg using (id))"
    for k in (1, 2):
        out += f", h{k} as materialized (select ids.id, coalesce(sum(p.v), 0) as v from ids left join {g} on src = ids.id left join h{k - 1} p on p.id = dst group by ids.id)"
    return out


query("un", _evmass("un") + " select id, round(ln(1 + h1.v), 5) as mass1, round(ln(1 + h1.v + h2.v), 5) as mass2 from h1 join h2 using (id)", "eigenvector_mass")(lambda e: rounded(algebra.eigenvector_mass(e, 2), 5))


def _pagerank(g: str, steps: int) -> str:
    out = f"+ids as (select src as id from {g} union select dst from {g}), n as (select count(*) as n from ids), o as (select src, count(*) as k from {g} group by src), p0 as (select id, 1.0 / n as v from ids, n)"
    for k in range(1, steps + 1):
        out += f", p{k} as materialized (select ids.id, 0.85 * coalesce(sum(p.v / o.k), 0) + 0.15 / any_value(n.n) as v from ids cross join n left join {g} on dst = ids.id left join o on o.src = {g}.src left join p{k - 1} p on p.id = {g}.src group by ids.id)"
    return out


query("lc", _pagerank("lc", 8) + " select id, round(v, 9) as value from p8", "pagerank")(lambda e: rounded(algebra.pagerank(e, iterations=8, tolerance=0), 9))
query("lc", _pagerank("lc", 8) + ", f as (select id, ln(1 + v * (select n from n)) as x from p8) select id, round(x / ((select max(x) from f) + 1e-6), 6) as value from f", "pagerank_feature")(
    lambda e: rounded(algebra.pagerank_feature(algebra.pagerank(e, iterations=8, tolerance=0))))
query("sp", _steps("sp", 3) + " select id, round(v / sqrt((select sum(v * v) from d3)), 6) as value from d3", "eigenvector")(lambda e: rounded(algebra.eigenvector(e, 3)))
query("sp", _DEG.format(g="sp") + " select a.id, round(2 * sum(1.0 / (a.deg + b.deg)) - 1, 6) as value from sp join d a on a.id = src join d b on b.id = dst group by a.id", "leverage")(lambda e: rounded(algebra.leverage(e)))


def _levels(g: str, sources: str, depth: int) -> str:
    """All levels of a breadth-first search; the last one has to be empty."""
    out, seen = f"+l0 as materialized (select id as source, id as node, 0 as dist, 1.0::double as sigma from ({sources}))", "select * from l0"
    for k in range(1, depth + 1):
        out += f""", l{k} as materialized (select source, dst as node, {k} as dist, sum(sigma) as sigma from l{k - 1} join {g} on src = node
          where (source, dst) not in (select (source, node) from ({seen})) group by source, dst)"""
        seen += f" union all select * from l{k}"
    return f"{out}, bfs as materialized ({seen})"


_IDS = "select src as id from {g} union select dst from {g}"
query("un", _levels("un", _IDS.format(g="un"), 6) + " select source, node, dist, sigma from bfs", "bfs")(lambda e: traverse.bfs(e, graph.vertices(e)))
query("geo", _levels("geo", _IDS.format(g="geo"), 5) + " select source as id, max(dist) as ecc from bfs group by source", "eccentricity")(lambda e: traverse.eccentricities(e, graph.vertices(e)))
query("un", _levels("un", _IDS.format(g="un"), 6) + f" select source as id, round(case when sum(dist) > 0 then (count(*) - 1) ** 2 / (((select count(*) from ({_IDS.format(g='un')})) - 1) * sum(dist)) else 0 end, 6) as score from bfs group by source", "closeness")(
    lambda e: rounded(traverse.closeness(e, graph.vertices(e))))


def _bc(g: str, depth: int) -> str:
    return _levels(g, _IDS.format(g=g), depth) + f""", ids as (select src as id from {g} union select dst from {g}),
 b as (select v.node as id, sum(v.sigma * w.sigma / t.sigma) as s from bfs v join bfs w on w.source = v.node join bfs t on t.source = v.source and t.node = w.node and v.dist + w.dist = t.dist
  where v.dist > 0 and w.dist > 0 group by v.node), n as (select count(*) as n from ids),
 bc as (select id, coalesce(s, 0) as raw, case when n > 2 then coalesce(s, 0) / ((n - 1) * (n - 2)) else 0 end as score from ids cross join n left join b using (id))"""  # fmt: skip


query("un", _bc("un", 6) + " select id, round(raw, 6) as score from bc", "betweenness")(lambda e: rounded(betweenness(e)))
query("geo", _bc("geo", 5) + " select id, round(raw, 6) as score from bc", "betweenness_forest")(lambda e: rounded(betweenness(e)))
query("un", _bc("un", 6) + " select id, round(raw, 6) as score from bc", "betweenness_by_joins")(lambda e: rounded(betweenness_by_joins(e)))
query("un", _bc("un", 6) + " select id, round(score, 9) as score from bc order by 2 desc, 1 limit 10", "betweenness_top10")(
    lambda e: _normalised(e).orderBy(F.col("score").desc(), "id").limit(10))


def _normalised(e: DataFrame) -> DataFrame:
    n = graph.vertices(e).agg(F.count("*").alias("n"))
    return betweenness(e).join(F.broadcast(n)).select("id", F.round(F.col("score") / ((F.col("n") - 1) * (F.col("n") - 2)), 9).alias("score"))


_REACH = "+reach as (select src as a, dst as b from {g} union select reach.a, dst from reach join {g} on src = b), ids as (select src as id from {g} union select dst from {g})"
_SCC = _REACH.format(g="lc") + ", scc as (select id, least(id, coalesce((select min(x.b) from reach x join reach y on y.a = x.b and y.b = x.a where x.a = id), id)) as component from ids)"
query("geo", _REACH.format(g="geo") + " select id, least(id, coalesce((select min(b) from reach where a = id), id)) as component from ids", "weak_components")(traverse.weak_components)
query("lc", _SCC + " select id, component from scc", "strong_components")(traverse.strong_components)
query("lc", _SCC + " select distinct a.component as src, b.component as dst from lc join scc a on a.id = src join scc b on b.id = dst where a.component != b.component", "condensation")(
    lambda e: traverse.condensation(e, traverse.strong_components(e)))
query("lc", _SCC + ", d as (select id, component, (select count(*) from lc where src = id) + (select count(*) from lc where dst = id) as k from scc) select component, id from d qualify row_number() over (partition by component order by k desc, id) = 1", "pivots")(
    lambda e: traverse.pivots(traverse.strong_components(e), algebra.degrees(e)))


# Of a forest the bound is twice the eccentricity of the pivot of the tree in which that is largest, 1 at least.
@query("geo", _REACH.format(g="geo") + """, tree as (select id, least(id, coalesce((select min(b) from reach where a = id), id)) as component, (select count(*) from geo where src = id) as k from ids),
hub as (select id, row_number() over (order by id) as n from tree qualify row_number() over (partition by component order by k desc, id) = 1),
walk as (select id as source, id as node, 0 as dist from hub union select source, dst, dist + 1 from walk join geo on src = node where dist < 6),
far as (select source, node, min(dist) as dist from walk group by all) select greatest(1.0, 2 * max(dist))::double as bound from far""", "diameter_bound")  # fmt: skip
def diameter(e: DataFrame) -> DataFrame:
    return e.sparkSession.createDataFrame([(traverse.diameter_bound(collected(e), False),)], "bound double")


@query("lc", None, "diameter_bound_directed")
def diameter_directed(e: DataFrame) -> DataFrame:
    return e.sparkSession.createDataFrame([(traverse.diameter_bound(collected(e), True),)], "bound double")


query("un", _levels("un", _IDS.format(g="un"), 4) + """, m as (select id from (select id, (select count(*) from (select src, dst from un union select dst, src from un) where src = id) as k from (select src as id from un union select dst from un)) order by k desc, id limit 2)
select id from m""", "landmarks_by_degree")(lambda e: e.sparkSession.createDataFrame([(i,) for i in traverse.landmarks(e, 2, "deg")], "id long"))  # fmt: skip
query("sp", "+marks as (select src as id from sp group by src order by count(*) desc, src limit 3)" + _levels("sp", "select id from marks", 5).replace("+l0", ", l0") + """, cap as (select 2.0 * max(dist) as cap from bfs), ids as (select distinct src as id from sp),
x as (select ids.id, marks.id as mark, ln(1 + coalesce(bfs.dist, cap)) as v from ids cross join marks cross join cap left join bfs on source = marks.id and node = ids.id), top as (select mark, max(v) + 1e-6 as top from x group by mark)
select id, round(min(v / top), 6) as least, round(max(v / top), 6) as most, round(avg(v / top), 6) as mean from x join top using (mark) group by id""", "landmark_stats")(
    lambda e: rounded(traverse.landmark_stats(traverse.landmark_distances(e, traverse.landmarks(e, 3, "deg")))))

# --- rank quality: out-degree as the truth, in-degree as the estimate
_PAIRS = _DEG.format(g="un") + ", p as (select id, deg::double as truth, indeg::double as pred from d)"
_paired = lambda e: algebra.degrees(e).select("id", F.col("deg").cast("double").alias("truth"), F.col("indeg").cast("double").alias("pred"))
query("un", _PAIRS + """, s as (select sum(sign(a.truth - b.truth) * sign(a.pred - b.pred)) as s, count(*) as n0, sum((a.truth = b.truth)::int) as n1, sum((a.pred = b.pred)::int) as n2 from p a join p b on a.id < b.id)
select (select count(*) from p) as n, round(s / n0, 6) as tau_a, round(s / sqrt((n0 - n1)::double * (n0 - n2)), 6) as tau_b from s""", "kendall")(lambda e: rounded(ranking.kendall(_paired(e))))  # fmt: skip
query("un", _PAIRS + ", t as (select id from p order by truth desc, id limit 20), q as (select id from p order by pred desc, id limit 20) select least((select count(*) from p), 20) as k, (select count(*) from t join q using (id)) as overlap", "top_overlap")(lambda e: ranking.overlap(_paired(e), 20))
query("un", _PAIRS + ", k as (select greatest(1, floor(count(*) * 10 / 100)::int) as k from p), r as (select id, row_number() over (order by truth desc, id) as a, row_number() over (order by pred desc, id) as b from p) select any_value(k) as k, round(sum((a <= k and b <= k)::int) / any_value(k), 6) as share from r, k", "top_share")(lambda e: rounded(ranking.top_share(_paired(e), 10)))
query("un", _PAIRS + ", r as (select truth, row_number() over (order by truth desc, id) as a, row_number() over (order by pred desc, id) as b from p) select round(sum(truth / log2(b + 1)) filter (b <= 20) / sum(truth / log2(a + 1)) filter (a <= 20), 6) as ndcg from r", "ndcg")(lambda e: rounded(ranking.ndcg(_paired(e), 20)))
query("un", _PAIRS + ", e as (select abs(truth - pred) as e from p) select count(*) as n, count(*) filter (e > 2) as wrong, round(avg(e), 6) as mae, round(stddev_pop(e), 6) as std, round(avg(e * e), 6) as mse, min(e) as least, quantile_cont(e, 0.25) as q1, quantile_cont(e, 0.5) as median, quantile_cont(e, 0.75) as q3, max(e) as max_ae from e", "error_summary")(lambda e: rounded(ranking.errors(_paired(e), 2)))
_TAU = "s as (select sum(sign(a.truth - b.truth) * sign(a.pred - b.pred)) as s, count(*) as n0, sum((a.truth = b.truth)::int) as n1, sum((a.pred = b.pred)::int) as n2 from {p} a join {p} b on a.id < b.id)"
_BOTH = " select (select count(*) from q) as n, round(s / n0, 6) as tau_a, round(s / sqrt((n0 - n1)::double * (n0 - n2)), 6) as tau_b from s"
query("un", _PAIRS + ", q as (select * from p order by truth desc, id limit 30), " + _TAU.format(p="q") + _BOTH, "kendall_top")(lambda e: rounded(ranking.kendall_top(_paired(e), 30)))
query("lc", _PAIRS.replace("from un", "from lc").replace("union select dst from un", "union select dst from lc") + ", q as (select id, pred as truth, truth as pred from p where pred > 0), " + _TAU.format(p="q") + _BOTH, "kendall_positive")(
    lambda e: rounded(ranking.kendall_positive(_paired(e).select("id", F.col("pred").alias("truth"), F.col("truth").alias("pred")))))
query("un", _PAIRS + ", m as (select a.id, a.truth, coalesce(b.pred, 0) as pred from p a left join p b on a.id = b.id + 1), " + _TAU.format(p="p") + ", " + _TAU.format(p="m").replace("s as (", "z as (", 1) + """, t as (select s.s / sqrt((s.n0 - s.n1)::double * (s.n0 - s.n2)) as tau, z.s / sqrt((z.n0 - z.n1)::double * (z.n0 - z.n2)) as shifted from s, z)
select round(tau, 6) as tau, round(shifted, 6) as shifted, tau > shifted + 0.1 as sound from t""", "offset_check")(
    lambda e: rounded(ranking.offset_check(_paired(e).select("id", F.col("truth").alias("score")), _paired(e).select("id", F.col("pred").alias("score")))))
query("un", _PAIRS + """, fit as (select sum(truth * pred) / sum(pred * pred) as f from (select * from p order by truth desc, id limit 1000)), k as (select 'raw' as kind, 1.0::double as scale union all select 'rescaled', 100 / 80.0 union all select 'fitted', f from fit),
e as (select kind, scale, id, truth, abs(pred * scale - truth) as e from p, k), w as (select kind, any_value(scale) as scale, max(e) as max_ae, count(*) filter (e > 2) as over_eps, avg(e) as mae from e group by kind),
t as (select kind, truth as top from e qualify row_number() over (partition by kind order by e desc, id) = 1)
select kind, round(max_ae, 6) as max_ae, over_eps, (select count(*) from p where truth > top) + 1 as argmax_rank, round(mae, 6) as mae, round(scale, 6) as scale from w join t using (kind)""", "bias_check")(lambda e: rounded(ranking.bias_check(_paired(e), 2, 100, 20)))  # fmt: skip
query("lc", " select id, side from (select src as id, 'truth' as side from lc where src not in (select dst from lc) union select dst, 'pred' from lc where dst not in (select src from lc))", "unmatched_keys")(
    lambda e: ranking.unmatched(e.select(F.col("src").alias("id")).distinct(), e.select(F.col("dst").alias("id")).distinct()))
query("un", _PAIRS + " select round(median(pred / truth), 6) as ratio from p where truth > 0", "median_scale")(lambda e: rounded(ranking.median_scale(_paired(e))))
query("un", _PAIRS + ", t as (select * from p order by truth desc, id limit 1000) select round(sum(truth * pred) / sum(truth * truth), 6) as slope from t", "fitted_scale")(lambda e: rounded(ranking.fitted_scale(_paired(e))))
query("un", _PAIRS + " select round(avg(greatest(0, 1 - sign(truth - pred) * (pred - truth))), 6) as loss from p", "margin_loss")(
    lambda e: rounded(ranking.margin_loss(_paired(e).select(F.col("pred").alias("s_u"), F.col("truth").alias("s_v"), F.signum(F.col("truth") - F.col("pred")).alias("y")))))
query("sp", _DEG.format(g="sp") + """, low as (select distinct deg as xmin from d where deg > 0 order by 1 limit 50),
tail as (select xmin, deg, row_number() over (partition by xmin order by deg) as i, count(*) over (partition by xmin) as n from low join d on deg >= xmin),
fit as (select xmin, n, 1 + n / sum(ln(deg / (xmin - 0.5))) as gamma from tail group by xmin, n having n >= 10),
gap as (select xmin, gamma, max(abs((tail.n - i + 1)::double / tail.n - (deg / (xmin - 0.5)) ** (1 - gamma))) as ks from tail join fit using (xmin) group by xmin, gamma)
select xmin, round(gamma, 6) as gamma, round(ks, 6) as ks from gap order by gap.ks, xmin limit 1""", "power_law")(lambda e: rounded(generators.power_law(algebra.degrees(e))))  # fmt: skip


@query(None, "select a.vec_id as src, b.vec_id as dst from embeddings a join embeddings b on a.vec_id != b.vec_id qualify row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) <= 3")
def embedding_neighbours(spark, sf_dir):
    return generators.nearest_by_cosine(tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), 3)


# --- sampling: the exact scores, and whether the estimates lie within a tolerance far below the largest score
def _facts(e: DataFrame, est: DataFrame, eps: float) -> DataFrame:
    both = _normalised(e).withColumnRenamed("score", "truth").join(est.select("id", "score"), "id", "left")
    return both.select("id", F.round("truth", 6).alias("truth"), F.coalesce(F.abs(F.col("truth") - F.col("score")) <= eps, F.lit(False)).alias("within"))


def _estimates(name: str, eps: float, estimate) -> None:
    query("geo", _bc("geo", 5) + " select id, round(score, 6) as truth, true as within from bc", name)(lambda e: _facts(e, estimate(e), eps))


_estimates("adaptive_sampling", 0.01, lambda e: sampling.adaptive(e, 0, 0.01, 0.1, directed=False).scores)
_estimates("path_estimator", 0.01, lambda e: sampling.fixed(e, "rk", 20_000))
_estimates("pair_estimator", 0.01, lambda e: sampling.fixed(e, "abra", 20_000))
_estimates("source_estimator", 0.02, lambda e: sampling.fixed(e, "bp", 3000))
_estimates("progressive_sampling", 0.02, lambda e: sampling.progressive(e, 0.02)[0])
query("geo", _bc("geo", 5) + ", top as (select id, score from bc order by score desc, id limit 3) select id, round(score, 6) as truth, true as found from top", "top_k_sampling")(
    lambda e: _normalised(e).orderBy(F.col("score").desc(), "id").limit(3).join(sampling.top_k(e, 3, 0.01, directed=False).select("id", "lower", "upper"), "id", "left").select(
        "id", F.round("score", 6).alias("truth"), F.coalesce(F.col("score").between(F.col("lower") - 1e-9, F.col("upper") + 1e-9), F.lit(False)).alias("found")))


@query(None)
def supplier_top_k(spark, sf_dir):
    """The ten largest of the whole supplier graph, estimated; exact scores are out of reach of SQL there."""
    return sampling.top_k(tables.supplier_part(spark, sf_dir), 10, 0.01, directed=False)


query("un", None, "graph_network")(lambda e: rounded(gnn.rank_scores(e, gnn.Weights.seeded(3), hops=3)))

# --- run logs: orders as runs, priorities as graphs, statuses as arms
_RUNS = "runs as (select o_orderpriority as graph, o_orderstatus as arm, o_custkey % 5 as seed, o_totalprice as seconds, (o_orderkey % 4)::int as threads, o_orderkey as id from orders)"


def _runs(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("graph"), F.col("o_orderstatus").alias("arm"), (F.col("o_custkey") % 5).alias("seed"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderkey") % 4).cast("int").alias("threads"), F.col("o_orderkey").alias("id"))


def runs(sql: str, name: str):
    def add(f):
        return query(None, f"with {_RUNS}{sql}", name)(lambda spark, sf_dir: rounded(f(_runs(spark, sf_dir)), 4))

    return add


_M = ", m as (select graph, arm, seed, avg(seconds) as seconds from runs group by all)"
_mean = lambda r: r.groupBy("graph", "arm", "seed").agg(F.avg("seconds").alias("seconds"))
runs(" select graph, arm, count(seconds) as n, round(avg(seconds), 4) as mean, round(coalesce(stddev_samp(seconds), 0), 4) as std from runs group by all", "run_means")(lambda r: runlog.means(r, ["graph", "arm"], "seconds"))
runs(" select graph, arm, round(min(seconds), 4) as least, round(median(seconds), 4) as median, round(max(seconds), 4) as most from runs group by all", "run_spread")(lambda r: runlog.spread(r, ["graph", "arm"], "seconds"))
runs(' select graph, round(avg(seconds) filter (arm = \'O\'), 4) as "O", round(avg(seconds) filter (arm = \'F\'), 4) as "F", round(avg(seconds) filter (arm = \'O\') / avg(seconds) filter (arm = \'F\'), 4) as ratio from runs group by graph', "run_speed_up")(lambda r: runlog.speed_up(r, ["graph"], "seconds", "arm", "O", "F"))
runs(""", t as (select graph, threads, median(seconds) as m from runs group by all) select graph, min_by(threads, m) as best_threads, round(min(m), 4) as best,
 round(max(m) filter (threads = 3) / max(m) filter (threads = 2), 4) as many_over_some, round(max(m) filter (threads = 1) / min(m), 4) as one_over_best from t group by graph""", "run_threads")(lambda r: runlog.thread_scaling(r, ["graph"], one=1, some=2, many=3))  # fmt: skip
_RATIO = _M + ", q as (select a.graph, a.seed, a.arm, a.seconds / b.seconds as seconds_ratio from m a join m b using (graph, seed) where b.arm = 'F' and a.arm != 'F')"
runs(_RATIO + " select graph, seed, arm, round(seconds_ratio, 4) as seconds_ratio from q", "run_ratios")(lambda r: runlog.paired_ratios(_mean(r), ["graph", "seed"], "arm", "F", ["seconds"]))
runs(_RATIO + " select arm, count(*) as n, round(avg(seconds_ratio), 4) as mean, round(stddev_samp(seconds_ratio), 4) as std, round(min(seconds_ratio), 4) as least, round(median(seconds_ratio), 4) as median, round(max(seconds_ratio), 4) as most, abs(avg(seconds_ratio) - 1) > stddev_samp(seconds_ratio) as beyond from q group by arm", "run_ratio_summary")(
    lambda r: runlog.ratio_summary(runlog.paired_ratios(_mean(r), ["graph", "seed"], "arm", "F", ["seconds"]), ["arm"], "seconds_ratio"))
runs(_RATIO + ", w as (select arm, sum((seconds_ratio < 1)::int) as wins, count(*) as n from q group by arm) select arm, wins, n, (case when wins = n then 'always' when wins = 0 then 'never' else 'mixed' end) || ' ' || wins || '/' || n as verdict from w", "run_wins")(
    lambda r: runlog.wins(runlog.paired_ratios(_mean(r), ["graph", "seed"], "arm", "F", ["seconds"]).withColumn("one", F.lit(1.0)), ["arm"], "seconds_ratio", "one"))
runs(", g as (select graph, arm, avg(seconds) as seconds from runs group by all) select graph, arm, round(seconds, 4) as seconds, dense_rank() over (partition by graph order by seconds desc) as place from g", "run_places")(
    lambda r: runlog.places(r.groupBy("graph", "arm").agg(F.avg("seconds").alias("seconds")), "graph", "arm", "seconds"))
runs(", g as (select graph, arm, avg(seconds) as seconds from runs group by all) select arm, round(case when count(*) = 5 then avg(seconds) end, 4) as mean from g group by arm", "run_complete_means")(
    lambda r: runlog.complete_means(r.groupBy("graph", "arm").agg(F.avg("seconds").alias("seconds")), "arm", "seconds", 5))
runs(", g as (select distinct graph from runs), a as (select distinct arm from runs), s as (select distinct seed from runs) select graph, arm, seed from g, a, s where (graph, arm, seed) not in (select (graph, arm, seed) from runs where seconds > 498000)", "run_missing")(
    lambda r: runlog.missing(runlog.run_matrix([r.select(c).distinct() for c in ("graph", "arm", "seed")]), r.where("seconds > 498000"), ["graph", "arm", "seed"]))
runs(_M + " select graph, arm, seed, round(seconds, 4) as seconds, round(sum(seconds) over (partition by graph, arm order by seed), 4) as running from m", "run_running")(lambda r: runlog.running(_mean(r), ["graph", "arm"], "seed", "seconds"))
runs(_M + " select graph, arm, seed, round(seconds, 4) as seconds, round(lag(seconds) over w, 4) as before, round(lead(seconds) over w, 4) as after from m window w as (partition by graph, arm order by seconds desc, seed)", "run_neighbours")(lambda r: runlog.with_neighbours(_mean(r), ["graph", "arm"], "seconds", "seed"))
runs(" select graph, arm, seed, round(seconds, 4) as seconds, threads, id from runs qualify row_number() over (partition by graph, arm order by id desc) = 1", "run_last")(lambda r: runlog.last_seeds(r, ["graph", "arm"], "id"))

_NAMED = ", x as (select graph || '_S' || seed || case when threads = 0 then '_filtered' else '' end as name, id as place, seconds, case when id % 7 = 0 then '-' else (id % 10)::varchar end as score from runs)"
_named = lambda r: r.select(F.concat("graph", F.lit("_S"), "seed", F.when(F.col("threads") == 0, "_filtered").otherwise("")).alias("name"), F.col("id").alias("place"), F.col("seconds").cast("string").alias("seconds"), F.when(F.col("id") % 7 == 0, "-").otherwise((F.col("id") % 10).cast("string")).alias("score"))
_SEEDS = _NAMED + ", g as (select regexp_replace(name, '_S\\d+', '') as base, min_by(name, place) as first, count(*) as n_seeds, avg(seconds) as seconds, avg(try_cast(score as double)) as score from x group by 1)"
_SEEDED = " select regexp_replace(first, '_S\\d+', '_' || n_seeds || '_seeds') as name, n_seeds, round(seconds, 4) as seconds, round(score, 4) as score from g"
runs(_SEEDS + _SEEDED, "run_seed_means")(lambda r: runlog.seed_means(_named(r), "name", ["seconds", "score"]))
runs(_SEEDS + _SEEDED + " where first like '%\\_filtered' escape '\\'", "run_filtered")(lambda r: runlog.seed_means(runlog.split_filtered(_named(r), "name")[1], "name", ["seconds", "score"]))
runs(" select graph, round(avg(seconds), 4) as seconds, round(2 * avg(threads), 4) as threads, min(seed) as seed from runs group by graph", "run_doubled_means")(lambda r: runlog.doubled_means(r, ["graph"], ["seconds"], ["threads"], ["seed"]))
runs(" select graph, arm, round(1 - avg(threads), 4) as threads, round(avg(seconds), 4) as seconds from runs group by all", "run_complements")(lambda r: runlog.complements(r, ["graph", "arm"], "threads", "seconds"))
runs(", i as (select graph, arm, min(seconds) as least, median(seconds) as median, max(seconds) as most from runs group by all) select graph, round(min(least), 4) as least, round(avg(median), 4) as median, round(max(most), 4) as most, count(*) as groups from i group by graph", "run_regrouped")(
    lambda r: runlog.regrouped(r, ["graph", "arm"], ["graph"], "seconds"))
runs(", m as (select graph, seed, avg(seconds) filter (arm = 'O') / avg(seconds) filter (arm = 'F') as ratio from runs group by all) select round(median(ratio), 4) as median_ratio, count(ratio) as n from m", "run_median_speed_up")(
    lambda r: runlog.seed_speed_up(r, ["graph", "seed"], "seconds", "arm", "O", "F"))
runs(", d as (select 'count' as summary, count(seconds)::double as seconds from runs union all select 'mean', avg(seconds) from runs union all select 'stddev', stddev_samp(seconds) from runs union all select 'min', min(seconds) from runs union all select 'max', max(seconds) from runs) select summary, round(seconds, 4) as seconds from d", "run_describe")(
    lambda r: r.select("seconds").summary("count", "mean", "stddev", "min", "max").select("summary", F.col("seconds").cast("double").alias("seconds")))
_STOPS = ", y as (select graph, seed % 3 as seed, case threads when 3 then 10 else 0 end as k, case arm when 'O' then 'code' when 'F' then 'paper' else 'cpp' end as variant, max(id) as samples from runs where id % 2 = 1 group by all)"
runs(_STOPS + """, w as (select graph, seed, k, max(samples) filter (variant = 'code') as code, max(samples) filter (variant = 'paper') as paper, max(samples) filter (variant = 'cpp') as cpp from y group by all)
select w.graph, w.k, round(avg(w.paper / w.code), 4) as paper_over_code, round(avg(w.cpp / w.code), 4) as cpp_over_code, round(avg(w.code / z.code), 4) as code_over_zero, round(avg(w.paper / z.code), 4) as paper_over_zero
from w left join w z on z.graph = w.graph and z.seed = w.seed and z.k = 0 group by all""", "run_predicted")(
    lambda r: runlog.predicted_summary(r.where("id % 2 = 1").groupBy("graph", (F.col("seed") % 3).alias("seed"), F.when(F.col("threads") == 3, 10).otherwise(0).alias("k"), F.when(F.col("arm") == "O", "code").when(F.col("arm") == "F", "paper").otherwise("cpp").alias("variant")).agg(F.max("id").alias("samples")), ["graph"], "seed"))

QUERIES |= files.QUERIES
ORACLE |= files.ORACLE
