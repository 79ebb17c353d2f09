"""Graph operators on graphs with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from centra.functions import bounds, ranking
from centra.functions.numbering import numbered
from centra.operators import algebra, generators, gnn, graph, sampling, traverse
from centra.operators.betweenness import betweenness, betweenness_by_joins
from centra.operators.csr import Csr, collected
from centra.plans import runlog


def table(spark, edges, directed=False):
    rows = edges if directed else [*edges, *((b, a) for a, b in edges)]
    return spark.createDataFrame(rows, "src long, dst long").distinct()


def csr(edges, directed=False):
    rows = np.array(edges if directed else [*edges, *((b, a) for a, b in edges)])
    rows = np.unique(rows, axis=0)
    return Csr(rows[:, 0], rows[:, 1])


STAR = [(1, i) for i in range(2, 6)]
PATH = [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_numbering_is_a_sort(spark):
    rows = [(random.Random(i).random(), i) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "x double, i long").repartition(7), [F.col("x"), F.col("i")]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.n)] == [i for _, i in sorted(rows)]


def test_betweenness_closed_forms(spark):
    star = {r.id: r.score for r in betweenness(table(spark, STAR)).collect()}
    assert star == {1: 12.0, 2: 0, 3: 0, 4: 0, 5: 0}
    path = {r.id: r.score for r in betweenness_by_joins(table(spark, PATH)).collect()}
    assert path == {1: 0, 2: 6, 3: 8, 4: 6, 5: 0}
    ends = {r.id: r.score for r in betweenness(table(spark, STAR), endpoints=True).collect()}
    assert ends[1] == 20 and ends[2] == 8


def test_betweenness_two_ways_and_limit(spark):
    rng = random.Random(1)
    edges = table(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range(70)], directed=True).where("src != dst")
    a = {r.id: r.score for r in betweenness(edges).collect()}
    b = {r.id: r.score for r in betweenness(edges, limit=1).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    with pytest.raises(ValueError):
        collected(edges, 1)


def test_searches_of_a_broadcast_graph_equal_those_by_joins(spark):
    rng = random.Random(5)
    ring = [(i, (i + 1) % 90) for i in range(90)]
    edges = table(spark, [*ring[:60], *((rng.randrange(90), rng.randrange(90)) for _ in range(150)), *((i, i + 1) for i in range(100, 110)), *((200, i) for i in range(201, 205)), *((i, 200) for i in range(201, 204))], directed=True)
    ids = graph.vertices(edges).unionByName(spark.createDataFrame([(999,), (5,)], "id long"))
    row = lambda df: sorted(tuple(r) for r in df.collect())
    for most in (None, 2):
        assert row(traverse.bfs(edges, ids, most)) == row(traverse.bfs(edges, ids, most, limit=0))
    assert row(traverse.closeness(edges, ids)) == row(traverse.closeness(edges, ids, limit=0))
    want = row(traverse.bfs(edges, ids, limit=0).groupBy("source").agg(F.max("dist")))
    assert row(traverse.eccentricities(edges, ids)) == want == row(traverse.eccentricities(edges, ids, limit=0))


def test_a_level_is_found_along_the_fewer_edges(monkeypatch):
    rng = np.random.default_rng(2)
    g, seen = csr(rng.integers(400, size=(6000, 2)).tolist(), True), []
    plain = Csr.expand
    monkeypatch.setattr(Csr, "expand", lambda self, at, to, border: seen.append(int((at[border + 1] - at[border]).sum())) or plain(self, at, to, border))
    dist, sigma, _, _ = g.paths(0)
    assert sum(seen) < g.m / 2  # each vertex's edges are not all looked at
    want = [1.0 if v == 0 else 0.0 for v in range(g.n)]
    for d in range(1, dist.max() + 1):
        for v in np.flatnonzero(dist == d):
            own = g.in_to[g.in_at[v] : g.in_at[v + 1]]
            assert dist[own].min() == d - 1
            want[v] = sum(want[u] for u in own if dist[u] == d - 1)
    assert sigma.tolist() == want


def test_nearest_by_cosine_is_that_of_sql(spark):
    import duckdb
    import pyarrow as pa

    from centra.plans.queries import ORACLE

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5)).tolist()
    x += [[v * k for v in x[0]] for k in (1, 2, 3, 7, 0.1)] + [x[1]] * 6 + [[0.0] * 5] * 2 + [None] * 2  # ties, multiples, no direction
    embeddings = pa.table({"vec_id": pa.array(rng.permutation(len(x))), "embedding": pa.array(x, pa.list_(pa.float64()))})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = sorted(con.execute(ORACLE["embedding_neighbours"]).fetchall())
    rows = spark.createDataFrame(embeddings).toDF("id", "x").repartition(3)
    for block in (1000, 20):
        assert sorted(tuple(r) for r in generators.nearest_by_cosine(rows, 3, block).collect()) == want
    assert generators.nearest_by_cosine(rows.limit(0), 3).count() == 0


def test_betweenness_by_joins_walks_a_broadcast_graph_from_many_sources(spark, monkeypatch):
    from centra.operators import betweenness as module

    rng = random.Random(6)
    edges = table(spark, [(rng.randrange(40), rng.randrange(40)) for _ in range(90)], directed=True).where("src != dst")
    some = graph.vertices(edges).where("id % 2 = 0").unionByName(spark.createDataFrame([(999,)], "id long"))
    monkeypatch.setattr(module, "SOURCES", 16)
    want = {r.id: r.score for r in betweenness_by_joins(edges, some, limit=0).collect()}
    monkeypatch.setattr(module, "dependencies", None)  # no round of joins
    got = {r.id: r.score for r in betweenness_by_joins(edges, some).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and max(want.values()) > 0


def test_products_of_large_tables_join_parts_of_bounded_size(spark, monkeypatch):
    from centra.functions import storage

    e = table(spark, [(i, j) for i in range(12) for j in range(i) if (i + j) % 3])
    row = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    want = [row(f(e)) for f in (algebra.leverage, algebra.degree_masses, algebra.eigenvector)]
    monkeypatch.setattr(storage, "ROWS", 5)
    assert want == [row(f(e)) for f in (algebra.leverage, algebra.degree_masses, algebra.eigenvector)]
    assert storage.spread(e, e.count(), "dst").rdd.getNumPartitions() == -(-e.count() // 5)


def test_line_graph_pairs_stream(spark):
    pairs, _ = graph.line_graph(table(spark, STAR + PATH))
    assert pairs.count() == pairs.distinct().count()
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # nothing holds the pairs


def test_sampled_paths_are_uniform():
    g = csr([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (0, 5), (5, 6), (6, 3), (2, 7), (7, 4)])
    # Shortest paths 0 -> 4: over 1-3, 2-3 and 2-7.
    counts = {}
    for i in range(3000):
        path = tuple(sorted(sampling.sample_path(g, 0, 4, np.random.default_rng(i))))
        counts[path] = counts.get(path, 0) + 1
    assert set(counts) == {(1, 3), (2, 3), (2, 7)} and all(abs(c - 1000) < 130 for c in counts.values())


def test_sampling_fixed_cases():
    g = csr(PATH)
    rng = np.random.default_rng(0)
    assert sorted(sampling.sample_path(g, 0, 4, rng, endpoints=True)) == [0, 1, 2, 3, 4]
    assert sampling.sample_path(g, 2, 2, rng) == [] and sampling.sample_path(csr([(1, 2), (2, 3), (4, 5)]), 0, 4, rng) == []


def test_adaptive_sampling(spark):
    got = sampling.adaptive(table(spark, STAR), 2, 0.5, 0.5, directed=False)
    assert got.samples > 0 and got.scores.orderBy(F.col("score").desc()).first().id == 1
    top = sampling.top_k(table(spark, STAR), 2, 0.5, 0.5).collect()
    assert len(top) >= 2 and top[0].id == 1 and all(r.lower <= r.score <= r.upper for r in top)
    for variant in bounds.VARIANTS:
        assert sampling.top_k(table(spark, [(0, i) for i in range(1, 50)]), 3, 0.3, 0.3, variant=variant).first().id == 0
    for wrong in ({"err": 0}, {"delta": 1}, {"variant": "x"}, {"normalise": "x"}):
        with pytest.raises(ValueError):
            sampling.adaptive(table(spark, STAR), **wrong)


def test_batches_do_not_change_samples(spark):
    sampler = sampling.Sampler(table(spark, PATH))
    whole = sampler.batch(sampling.path_counts, 2, 0, 100)
    parts = sampler.batch(sampling.path_counts, 2, 0, 37) + sampler.batch(sampling.path_counts, 2, 37, 100)
    assert (whole == parts).all()


def test_bounds():
    f, g = bounds.deviation_below(np.array([0.5]), 1000, 0.1, 1500), bounds.deviation_above(np.array([0.5]), 1000, 0.1, 1500)
    assert 0 <= f[0] <= 0.5 and 0 <= g[0] <= 0.5
    b = np.array([0.30, 0.20, 0.18, 0.05, 0.04, 0.01, 0.005])
    (pl, pu), (cl, cu) = bounds.error_budgets(b, 3, 0.001, variant="paper"), bounds.error_budgets(b, 3, 0.001, variant="code")
    assert pl[0] < 1 < cl[0] and pl[1] == cu[1] and pu[1] == cl[1]
    low, up = bounds.calibrated_deltas(b, np.full(7, 0.01), np.full(7, 0.01), 50, 0.01, 0.1)
    assert 0 < low.sum() + up.sum() + 43 * (low[-1] + up[-1]) <= 0.05 + 1e-9
    assert bounds.worst_case_samples(2, 0.1, 0.1) == pytest.approx(50 * (1 + math.log(5)))
    with pytest.raises(ValueError):
        bounds.error_budgets(b, 3, 0.001, variant="none")


def test_diameter_bound_holds():
    rng = random.Random(3)
    for _ in range(40):
        edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(1, 25))]
        edges = [e for e in edges if e[0] != e[1]] or [(0, 1)]
        for directed in (True, False):
            g = csr(edges, directed)
            assert traverse.diameter_bound(g, directed) >= max(g.distances(v)[1] for v in range(g.n))


def test_strong_components_agree(spark):
    rng = random.Random(8)
    edges = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(40)) if a != b})
    g = csr(edges, True)
    of, order = g.strong_components()
    reach = {v: set(np.flatnonzero(g.distances(v)[0] >= 0)) for v in range(g.n)}
    for a, b in itertools.combinations(range(g.n), 2):
        assert (of[a] == of[b]) == (a in reach[b] and b in reach[a])
        if of[a] != of[b] and b in reach[a]:
            assert of[a] > of[b]  # sinks first
    got = {r.id: r.component for r in traverse.strong_components(table(spark, edges, True)).collect()}
    assert got == {int(g.ids[v]): int(g.ids[np.flatnonzero(of == of[v])].min()) for v in range(g.n)}


def test_normalisation(spark):
    e = table(spark, [(10, 20), (20, 30), (30, 30)])
    moved, ids = graph.relabel(graph.drop_loops(e))
    assert {r.id: r.n for r in ids.collect()} == {10: 0, 20: 1, 30: 2} and moved.count() == 4
    assert graph.one_based(moved).agg(F.min("src")).first()[0] == 1
    assert graph.one_sided(e).count() == 0 and graph.one_sided(table(spark, [(1, 2)], True)).count() == 1
    assert graph.symmetrise(graph.orient(e)).where("src != dst").count() == 4
    p = graph.permutation(graph.vertices(e)).collect()
    assert sorted(r.n for r in p) == [0, 1, 2]
    assert graph.drop_edges(e, algebra.degrees(e), 1.0, least=0).count() == 0 and graph.drop_edges(e, algebra.degrees(e), 1.0).count() == 4
    assert graph.scale(5, "graphs") == pytest.approx(20 / 12) and graph.scale(2) == 0 and graph.scale(5, "none", False) == 10 and graph.scale(9, "pairs") == 1


def test_masks(spark):
    triangle = table(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    assert {r.id: r["mask"] for r in graph.clique_mask(triangle).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_algebra(spark):
    e = table(spark, STAR)
    m = {r.id: (r.mass1, r.mass2) for r in algebra.degree_masses(e, 2, log=False).collect()}
    assert m[1] == (4, 8) and m[2] == (1, 5)
    p = algebra.pagerank(e).agg(F.sum("value")).first()[0]
    assert p == pytest.approx(1, abs=1e-6)
    mass = algebra.eigenvector_mass(e, 2).collect()
    assert len(mass) == 5 and all(r.mass2 >= r.mass1 for r in mass)
    assert algebra.parse_init_type("AW_pr_sp8_ff") == {"base": "AW", "pagerank": True, "landmarks": 8, "mode": "ff"}
    assert {tuple(r)[1:] for r in algebra.features(e, "degree_mix_max_sum").collect() if r.id == 2} == {tuple(math.log1p(x) for x in (1, 4, 4, 1, 4, 1))}
    assert [len(algebra.features(e, k).columns) for k in ("random_3", "degree0", "ev_mix_mass_2", "degree_mix_mass_3", "positional_encoding_3d")] == [4, 2, 3, 4, 37]
    with pytest.raises(ValueError):
        algebra.features(e, "x")


def test_landmarks(spark):
    e = table(spark, PATH)
    assert traverse.landmarks(e, 3, "ff")[0] == 2 and set(traverse.landmarks(e, 2, "ff")) == {2, 5}
    d = {(r.id, r.landmark): r.value for r in traverse.landmark_distances(e, [1]).collect()}
    assert d[(5, 1)] == pytest.approx(math.log1p(4))


def metric_table(spark, truth, pred):
    return spark.createDataFrame(list(zip(range(len(truth)), map(float, truth), map(float, pred))), "id long, truth double, pred double")


def test_kendall_goldens(spark):
    truth = list(range(1, 100))
    for place, value in ((3, 0.9987631416202845), (98, 0.9595959595959596)):
        pred = list(truth)
        pred[place] = 0
        row = ranking.kendall(metric_table(spark, truth, pred)).first()
        assert row.tau_a == pytest.approx(value, abs=1e-9)
    rng = random.Random(4)
    a, b = [rng.randrange(9) for _ in range(300)], [rng.randrange(9) for _ in range(300)]
    want = sum((a[i] - a[j]) * (b[i] - b[j]) < 0 for i, j in itertools.combinations(range(300), 2))
    assert ranking.discordant(metric_table(spark, a, b), bits=4, small=0) == want == ranking.discordant(metric_table(spark, a, b))
    assert math.isnan(ranking.kendall(metric_table(spark, [], [])).first().tau_a) and ranking.kendall(metric_table(spark, [1], [2])).first().tau_b == 1


def test_ranking_loss_golden(spark):
    pred, target = [0.5, 0.7, 3.0], [0.2, 1.0, 2.0]
    pairs = [(i, j) for i in range(3) for j in range(3)]
    rows = [(pred[i], pred[j], target[i], target[j]) for i, j in pairs]
    got = ranking.ranking_cross_entropy(spark.createDataFrame(rows, "pred_u double, pred_v double, target_u double, target_v double")).first()[0]
    sig = lambda x: 1 / (1 + math.exp(-x))
    want = np.mean([-(sig(c - d) * math.log(sig(a - b)) + (1 - sig(c - d)) * math.log(1 - sig(a - b))) for a, b, c, d in rows])
    assert got == pytest.approx(want)


def test_top_k_and_errors(spark):
    t = metric_table(spark, range(10), range(10))
    assert ranking.overlap(t, 4).first().overlap == 4 and ranking.ndcg(t, 5).first().ndcg == 1 and ranking.top_share(t, 10).first().share == 1
    e = ranking.errors(metric_table(spark, [0, 1, 2], [0, 1, 5]), 1).first()
    assert (e.wrong, e.max_ae, e.mae, e.mse) == (1, 3, 1, 3)


def test_network_is_equivariant(spark):
    e = table(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (4, 5)], True)
    w = gnn.Weights.seeded(2)
    a = {r.id: r.score for r in gnn.rank_scores(e, w, 2).collect()}
    b = {r.id: r.score for r in gnn.rank_scores(e.select((F.col("src") * 7).alias("src"), (F.col("dst") * 7).alias("dst")), w, 2).collect()}
    assert {k * 7: pytest.approx(v) for k, v in a.items()} == b
    add, back = ({r.id: r.score for r in gnn.rank_scores(e, w, 2, fusion=f).collect()} for f in ("add", "back"))
    head = [(np.array([[1.0, 0.5], [2.0, -1.0]]), np.array([0.1, 0.2])), (np.array([[1.0], [3.0]]), np.array([0.3]))]
    cat = {r.id: r.score for r in gnn.rank_scores(e, w, 2, fusion="cat_mlp", head=head).collect()}
    for i, both in add.items():
        z = np.array([both - back[i], back[i]])
        assert cat[i] == pytest.approx((np.maximum(z @ head[0][0] + head[0][1], 0) @ head[1][0] + head[1][1])[0]) and a[i] == pytest.approx(z[0] * z[1])
    truth = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "id long, score double")
    y = gnn.pairs(truth, 5).collect()
    assert y and all(r.y == np.sign(r.s % 3 - r.t % 3) != 0 for r in y)


def test_weights_round_trip(tmp_path):
    w = gnn.Weights.seeded(3, layers=3)
    w.save(str(tmp_path / "w.npz"))
    v = gnn.Weights.load(str(tmp_path / "w.npz"))
    assert len(v.layers) == 3 and all((a == b).all() for x, y in zip([w.embed, *w.scorer], [v.embed, *v.scorer]) for a, b in zip(x, y))


def test_generators(spark):
    e = generators.gnp(spark, 200, 0.05, 1)
    assert graph.one_sided(e).count() == 0 and abs(e.count() - 200 * 199 * 0.05) < 300
    assert generators.gnp(spark, 10, 1.0, directed=True).count() == 90 and generators.gnp(spark, 10, 0.0).count() == 0
    assert generators.preferential(spark, 50, 2).count() == 2 * 2 * 48
    assert generators.scale_free(spark, 60).where("src = dst").count() == 0
    near = generators.disk_neighbours(generators.disk_points(spark, 40), 3)
    assert near.groupBy("src").count().where("count != 3").count() == 0
    assert generators.partition_graph(spark, 40, 10, 1.0, 0.0).count() == 40 * 9


def test_network_gradient_and_training(spark):
    rng = np.random.default_rng(2)
    rows = np.unique(rng.integers(0, 12, (40, 2)), axis=0)
    rows = rows[rows[:, 0] != rows[:, 1]]
    g = Csr(rows[:, 0], rows[:, 1])
    kept = np.ones(g.n, bool)
    streams = [(m, m.masses(3)) for m in (gnn._Sparse(g.out_at, g.out_to, kept), gnn._Sparse(g.in_at, g.in_to, kept))]
    w = gnn.Weights.seeded(3, hidden=5)
    s, t = rng.integers(g.n, size=60), rng.integers(g.n, size=60)
    y = rng.choice([-1.0, 1.0], 60)
    loss, grads = gnn.loss_and_gradient(streams, w, s, t, y)
    for p, d in ((w.embed[0], grads.embed[0]), (w.layers[0][0], grads.layers[0][0]), (w.layers[1][1], grads.layers[1][1]), (w.scorer[0][0], grads.scorer[0][0]), (w.scorer[2][1], grads.scorer[2][1])):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        p[at] += 1e-6
        more = gnn.loss_and_gradient(streams, w, s, t, y)[0]
        p[at] -= 1e-6
        assert (more - loss) / 1e-6 == pytest.approx(d[at], rel=2e-3, abs=1e-6)
    edges = generators.preferential(spark, 60, 2)
    fitted, losses = gnn.train(edges, betweenness(edges), hops=3, epochs=60, rate=0.02)
    assert losses[-1] < losses[0]
    # The joins and the driver's kernels give the same scores.
    small = spark.createDataFrame(list(map(tuple, rows.tolist())), "src long, dst long")
    got = {r.id: r.score for r in gnn.rank_scores(small, w, 3).collect()}
    keep = np.isin(g.ids, [r.id for r in graph.between(small).collect()])
    own = [(m, m.masses(3)) for m in (gnn._Sparse(g.out_at, g.out_to, keep), gnn._Sparse(g.in_at, g.in_to, keep))]
    want = gnn.stream_forward(*own[0], w)[0] * gnn.stream_forward(*own[1], w)[0]
    assert got == {int(i): pytest.approx(v) for i, v in zip(g.ids, want)}


def test_predicted_stop():
    b = np.array([0.3, 0.1, 0.05, 0.01])
    omega = bounds.worst_case_samples(6, 0.02, 0.1)
    low, up = bounds.calibrated_deltas(b, *bounds.error_budgets(b, 0, 0.02), 100, 0.02, 0.1)
    stop = bounds.predicted_stop(b, 0, 0.02, low, up, omega)
    assert 1 < stop <= math.ceil(omega)
    assert not bounds.finished(b, stop - 1, 0, 0.02, low, up, omega) and len(bounds.unfinished(b, stop - 1, 0, 0.02, low, up, omega))


def test_strong_components_by_joins_and_on_the_driver(spark):
    rng = random.Random(6)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})
    reach = {v: {v} for e in edges for v in e}
    for _ in range(40):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    for small in (0, 10**6):
        got = {r.id: r.component for r in traverse.strong_components(table(spark, edges, directed=True), small).collect()}
        assert got == want
    assert len(set(want.values())) > 3


def test_paths_of_a_pair_and_several_draws(spark):
    grid = [(x * 3 + y, x * 3 + y + d) for x in range(3) for y in range(3) for d in ([3] if x < 2 else []) + ([1] if y < 2 else [])]
    g = Csr(*(np.array(c) for c in zip(*grid, *((b, a) for a, b in grid), *grid)))
    assert g.m == 24  # each edge given twice in one direction counts once
    paths = sampling.all_paths(g, 0, 8)
    assert len(paths) == 6 and all(p[0] == 0 and p[-1] == 8 and len(p) == 5 for p in paths) and len({tuple(p) for p in paths}) == 6
    assert sampling.all_paths(g, 4, 4) == []
    exact = sum(g.dependency(v) for v in range(9)) / 72
    assert np.abs(sampling.multi_path_counts(g, 1, 2, 0, 4000) / 4000 - exact).max() < 0.02


def test_samplers_refuse_what_they_cannot_draw(spark):
    complete = table(spark, [(a, b) for a in range(5) for b in range(5) if a != b])
    with pytest.raises(ValueError):
        sampling.fixed(complete, "rk", 10)
    for run in (lambda e: sampling.fixed(e, "abra", 10), lambda e: sampling.progressive(e, 0.1), lambda e: sampling.timed(e, "bp", 0.1)):
        for edges in (table(spark, [(1, 2)]).limit(0), table(spark, [(3, 3)])):
            with pytest.raises(ValueError):
                run(edges)
    scores, done = sampling.timed(complete, "abra", 0.5)
    assert done >= 500 and scores.count() == 5


def test_oracle_allocation(spark):
    e = table(spark, STAR)
    truth = betweenness(e).select("id", (F.col("score") / 20).alias("score"))
    got = sampling.oracle_allocation(e, truth, 1, err=0.05, directed=False).collect()
    assert got[0].id == 1 and got[0].share == pytest.approx(0.6) and all(0 < r.low < 0.1 and 0 < r.up < 0.1 for r in got)


def test_congruential_generator_and_schedules():
    draw = bounds.Congruential(1)
    assert draw.next() == (6364136223846793005 + 1442695040888963407) % 2**64
    seen = [draw.below(7) for _ in range(7000)]
    assert set(seen) == set(range(7)) and max(seen.count(k) for k in range(7)) < 1200
    assert bounds.schedule(10, 20, 1.2) == [10, 12, 15, 18, 20] and bounds.schedule(5, 5) == [5]
    m = bounds.source_samples(100, 0.05, 0.1)
    assert bounds.source_sample_error(100, m, 0.1) <= 0.05 < bounds.source_sample_error(100, m - 2, 0.1)


def test_further_generators(spark):
    ring = generators.small_world(spark, 30, 4, 0.0)
    assert {r["count"] for r in ring.groupBy("src").count().collect()} == {4}
    assert generators.small_world(spark, 30, 4, 0.5, 3).exceptAll(ring).count() > 0
    tri = generators.clustered_preferential(spark, 60, 3, 0.9, 2)
    assert tri.count() == 2 * 3 * 57 and graph.one_sided(tri).count() == 0
    groups = generators.gaussian_partition(spark, 120, 20, 10, 0.9, 0.01, 4)
    assert graph.one_sided(groups).count() == 0 and 120 * 10 < groups.count() < 120 * 30


def test_deeper_models_against_dense_algebra(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 9, (30, 2)) if a != b})
    e, ids = table(spark, edges, directed=True), sorted({v for x in edges for v in x})
    place = {v: i for i, v in enumerate(ids)}
    A = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        A[place[a], place[b]] = 1
    kept = {r.id for r in graph.between(e).collect()}
    D = np.diag([float(v in kept) for v in ids])

    def features(m):
        d, total, out = np.ones(len(m)), 0, []
        for _ in range(2):
            d = m @ d
            total = total + d
            out.append(np.log1p(total))
        return np.stack(out, 1)

    def run(m, f, w, layers):
        x = gnn.unit(np.maximum(f @ w.embed[0] + w.embed[1], 0))
        score = gnn.mlp(x, w.scorer)
        for i, (k, b) in enumerate(layers):
            x = np.maximum(m @ (x @ k) + b, 0)
            x = x if i + 1 == len(layers) else gnn.unit(x)
            score = score + gnn.mlp(x, w.scorer)
        return score

    w = gnn.Weights.seeded(2, layers=4, seed=5)
    forth, back = D @ A, D @ A.T
    want = run(forth, features(forth), w, w.layers) * run(back, features(back), w, [*w.layers[:3], w.layers[2]])
    got = {r.id: r.score for r in gnn.deep_scores(e, w, hops=2).collect()}
    assert np.allclose([got[v] for v in ids], want)
    w = gnn.Weights.seeded(2, layers=6, seed=6)
    got = {r.id: r.score for r in gnn.deep_scores(e, w, "closeness", hops=2).collect()}
    assert np.allclose([got[v] for v in ids], run(A.T @ D, features(A), w, w.layers))
    state, sent = gnn.master_update(np.zeros(2), spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, x array<double>"), (np.ones((4, 2)) * 0.1, np.zeros(2)), (np.eye(2), np.ones(2)))
    assert np.allclose(state, np.tanh(0.5)) and np.allclose(sent, np.tanh(0.5) + 1)


def test_predicted_stops(spark):
    rows = ["# k = 0", "  code  100 samples", "  paper  80 samples", "## k = 10", "  code  50 samples", "  cpp does NOT stop", "  code  60 samples"]
    lines = spark.createDataFrame([("g", i, v) for i, v in enumerate(rows)], "log string, line long, value string")
    got = {(r.k, r.variant): r.samples for r in runlog.predicted_stops(lines).collect()}
    assert got == {(0, "code"): 100, (0, "paper"): 80, (10, "code"): 60, (10, "cpp"): None}
