"""Reading and writing text formats."""

from pyspark.sql import functions as F

from centra.operators import graph
from centra.plans import runlog
from centra.sources import sinks, text


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_edges(spark, tmp_path):
    path = write(tmp_path, "g.txt", ["# comment", "% other", "", "0 1 9", "0\t1", "1 2", "x y", "7"])
    assert sorted(map(tuple, text.read_edges(spark, path).collect())) == [(0, 1), (1, 2)]
    assert sorted(map(tuple, text.read_edges(spark, path, directed=False, shift=True).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert [r.value for r in text.bad_lines(spark, path).orderBy("value").collect()] == ["7", "x y"]
    out = str(tmp_path / "out")
    sinks.write_edges(text.read_edges(spark, path, directed=False), out, once=True)
    assert sorted(map(tuple, text.read_edges(spark, out).collect())) == [(0, 1), (1, 2)]


def test_relabel_by_first_line(spark, tmp_path):
    edges, ids = text.read_edges_relabelled(spark, write(tmp_path, "g.txt", ["50 7", "7 3", "50 3"]))
    assert {r.id: r.n for r in ids.collect()} == {50: 0, 7: 1, 3: 2} and sorted(map(tuple, edges.collect())) == [(0, 1), (0, 2), (1, 2)]


def test_manifest_truth_and_scores(spark, tmp_path):
    got = text.read_instances(spark, write(tmp_path, "i.txt", ["# c", "a.txt U", "b.txt D"])).collect()
    assert sorted(map(tuple, got)) == [("a.txt", False), ("b.txt", True)]
    truth = text.read_truth(spark, write(tmp_path, "t.csv", ["node,betweenness", "0,1.5", "2,0.5"]))
    assert sorted(map(tuple, truth.collect())) == [(1, 1.5), (3, 0.5)]
    ids = spark.range(1, 4).toDF("id")
    assert sorted(map(tuple, text.zero_filled(ids, truth).collect())) == [(1, 1.5), (2, 0.0), (3, 0.5)]
    assert sorted(map(tuple, text.read_score_lines(spark, write(tmp_path, "s.txt", ["1.0", "", "3e-1"])).collect())) == [(0, 1.0), (2, 0.3)]


def test_parsers(spark):
    lines = spark.createDataFrame([("1) 5 0.1 0.2 0.3",), ("? 2) 6 0 0.1 0.2",), ("Total time: 3.5",), ("4 0.5",), ("9,0.5",), ("8 : 1e-3",)], "value string")
    assert sorted(map(tuple, text.parse_ranked(lines).collect())) == [(1, 5, 0.1, 0.2, 0.3, False), (2, 6, 0.0, 0.1, 0.2, True)]
    assert text.parse_total_time(lines).first()[0] == 3.5
    assert [tuple(text.parse_scores(lines, k).first()) for k in ("plain", "csv", "colon")] == [(4, 0.5), (9, 0.5), (8, 0.001)]
    assert text.parse_scores(lines, "csv", n=5).count() == 0


def test_runs(spark, tmp_path):
    write(tmp_path, "julia_web_t8_s0.json", ['{"parameters": {"threads": 8, "k": 0},', ' "execution_time_seconds": 2.5, "num_samples": 7}'])
    write(tmp_path, "other.json", ["{}"])
    row = text.read_runs(spark, str(tmp_path / "*.json"), "threads").first()
    assert (row.impl, row.graph, row.threads, row.seed, row.parameters.threads, row.execution_time_seconds) == ("julia", "web", 8, 0, 8, 2.5)
    assert text.read_runs(spark, str(tmp_path / "j*.json"), more="x_omega double").first().x_omega is None
    out = str(tmp_path / "runs")
    sinks.write_runs(text.read_runs(spark, str(tmp_path / "j*.json")), out, scores=False)
    assert text.read_runs(spark, out, lines=True).first().num_samples == 7


def test_logs(spark):
    rows = ["seed : 4", "graph a tau 0.5", "graph a tau 0.7", "seed : 5", "graph a tau 0.6", "Done: x", "Done: y"]
    lines = spark.createDataFrame([("l", i, v) for i, v in enumerate(rows)], "log string, line long, value string")
    got = text.parse_log(lines, r"graph (\w+) tau ([.\d]+)", ["graph", "tau"])
    assert sorted((r.seed, r.graph, r.tau) for r in got.collect()) == [("4", "a", "0.5"), ("5", "a", "0.6")]
    assert text.last_values(lines, ["Done:"]).first().Done == "y"


def test_wide_results(spark, tmp_path):
    path = write(tmp_path, "r.csv", ["Algorithm,web,soc", "x_S1,0.5,-", "x_S1,0.6,-", "y,1,2"])
    got = {(r.algorithm, r.seed, r.graph): r.value for r in text.read_wide_results(spark, path).collect()}
    assert got == {("x", 1, "web"): 0.6, ("x", 1, "soc"): None, ("y", None, "web"): 1.0, ("y", None, "soc"): 2.0}
    long = spark.createDataFrame([("x", "tau", "web", 0.5), ("x", "tau", "soc", 0.7)], "algorithm string, metric string, graph string, value double")
    assert sinks.wide_results(long, ["soc", "web"]).first().asDict() == {"metric": "tau", "algorithm": "x", "soc": 0.7, "web": 0.5}
    assert sinks.markdown(long.limit(1)).first()[0].startswith("| x | tau |")
    timing = write(tmp_path, "t.csv", ["Dataset,Nodes,Edges,Runtime_s,Status", "a,1,2,3.5,bad", "a,1,2,4.5,ok"])
    assert text.read_timings(spark, timing).first().seconds == 4.5


def test_training_instance(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    sinks.write_training_instance(e, graph.vertices(e), spark.createDataFrame([(1, 2.0)], "id long, score double"), str(tmp_path / "x"))
    got = spark.read.csv(str(tmp_path / "x/scores"), header=True, inferSchema=True)
    assert sorted(map(tuple, got.collect())) == [(0, 0.0), (1, 2.0), (2, 0.0)]


def test_improvement(spark):
    means = spark.createDataFrame([("me", 3.0), ("a", 2.0), ("b", 1.0)], "name string, mean double")
    assert runlog.improvement(means, "name", "me").first().percent == 50
    assert runlog.grid(spark.createDataFrame([(1, 2, 4.0), (1, 2, 6.0)], "l int, w int, v double"), "l", "w", [2], "v").first()["2"] == 5
    assert runlog.medians(means, ["name"], ["mean"]).where(F.col("name") == "a").first()["mean"] == 2


def test_edges_of_order_lines_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from centra.functions import storage
    from centra.sources import tables

    lines = [(i % 7, i % 3 if i % 5 else None, None if i % 11 == 0 else i % 4) for i in range(60)] + [(1, None, None)] * 2
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    twice = lambda p: sorted(map(repr, p | {(b, a) for a, b in p}))
    times = lambda x, k: None if x is None else 2 * x + k
    sp = {(times(s, 0), times(p, 1)) for _, p, s in lines}
    cs = {(2 * (o % 2), times(s, 1)) for o, _, s in lines if o < 6}
    monkeypatch.setattr(storage, "ROWS", 5)
    for got, want, parts in ((tables.supplier_part(spark, str(tmp_path)), sp, 13), (tables.customer_supplier(spark, str(tmp_path)), cs, 13)):
        assert sorted(repr(tuple(r)) for r in got.collect()) == twice(want)
        assert got.rdd.getNumPartitions() == parts  # as many as the rows need


def test_headers_hold_across_runs_of_lines(spark, monkeypatch):
    said = ["graph a tau 1", "seed : 4", "graph a tau 2", "x", "y", "z", "graph b tau 3", "graph a tau 9", "seed : 5", "seed : 6", "graph a tau 7"]
    rows = [(log, i, v) for log in ("one", None) for i, v in enumerate(said)]
    want = [(log, *r) for log in ("one", None) for r in ((None, "a", "1"), ("4", "a", "2"), ("4", "b", "3"), ("6", "a", "7"))]
    lines = spark.createDataFrame(rows, "log string, line long, value string").repartition(3)
    monkeypatch.setattr(text, "LINES", 3)
    got = text.parse_log(lines, r"graph (\w+) tau ([.\d]+)", ["graph", "tau"])
    assert sorted(repr((r.log, r.seed, r.graph, r.tau)) for r in got.collect()) == sorted(map(repr, want))
    # Only runs, of which there are few, are ordered within a whole log.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [" in line and "__run" not in line.split("], [")[1]] == [line for line in plan.splitlines() if "AS __before" in line and "Window [" in line]


def test_edge_lists_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    from centra.functions import storage

    spark.createDataFrame([(f"{i % 9},{i % 5}",) for i in range(40)] + [("3,1",), ("# 1,2",)], "value string").write.text(f"{tmp_path}/e")
    monkeypatch.setattr(storage, "ROWS", 10)
    got = text.read_edges(spark, f"{tmp_path}/e", directed=False)
    pairs = {(i % 9, i % 5) for i in range(40)}
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(pairs | {(b, a) for a, b in pairs})
    assert got.rdd.getNumPartitions() == 9
