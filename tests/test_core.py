"""Hand-worked values, brute-force comparisons and strategy agreement on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import stats
from netloom.operators import correlation, counts, graphs, intervals, katz, motifs, neighborhoods, neighbors, orientation, ranks, skeleton


def long(spark, x, module="m"):
    rows = [(module, i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double")


def brute_ranges(x, fraction):
    n = len(x)
    w = int(fraction * n)
    lo, hi = np.zeros_like(x), np.zeros_like(x)
    for g in range(x.shape[1]):
        s = np.sort(x[:, g])
        m = int((s <= 0).sum())
        for k in range(n):
            t0, t1 = np.searchsorted(s, x[k, g], "left"), np.searchsorted(s, x[k, g], "right")
            if t1 - t0 > w:
                a, b = t0, t1 - 1
            else:
                a, b = max(m if w < m < n else 0, t0 - w), min(n - 1, t1 - 1 + w)
            lo[k, g], hi[k, g] = s[a], s[b]
    return lo, hi


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(90, 3))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.1 * rng.normal(size=90), base[:, 1], base[:, 1] + base[:, 0],
                         np.round(base[:, 2]), rng.normal(size=90)])
    return np.maximum(x, 0.0)


def test_fixture_neighbourhoods(spark):
    x = np.array([[0, 0, 0, 1, 2, 3, 4, 5, 6, 7], [-5, -4, -3, -2, -1, 0, 1, 2, 3, 4]], float).T
    found = {(r.cell_id, r.gene): (r.lo, r.hi) for r in neighborhoods.cell_neighborhoods(long(spark, x), 0.2).collect()}
    assert [found[k, 0] for k in (0, 3, 6, 9)] == [(0, 0), (1, 3), (2, 6), (5, 7)]
    assert [found[k, 1] for k in (0, 5, 9)] == [(1, -3), (1, 2), (2, 4)]
    size = {(r.cell_id, r.gene): r.members for r in neighborhoods.neighborhood_sizes(long(spark, x), 0.2).collect()}
    assert [size[k, 0] for k in (0, 3, 6, 9)] == [3, 3, 5, 3] and [size[k, 1] for k in (0, 5, 9)] == [0, 2, 3]


def test_hot_values_and_block_borders(spark, monkeypatch):
    for module in (ranks, neighborhoods):
        monkeypatch.setattr(module, "POSITIONS_PER_CHUNK", 7)
    rng = np.random.default_rng(3)
    x = np.column_stack([np.where(rng.random(80) < 0.4, 0.0, rng.integers(1, 30, 80)), rng.normal(size=80)]).astype(float)
    lo, hi = brute_ranges(x, 0.1)
    for r in neighborhoods.cell_neighborhoods(long(spark, x), 0.1).collect():
        assert (r.lo, r.hi) == (lo[r.cell_id, r.gene], hi[r.cell_id, r.gene])


def test_pair_counts_match_brute_force_and_dyadic(spark, matrix):
    expr = long(spark, matrix)
    lo, hi = brute_ranges(matrix, 0.1)
    inside = (matrix[None] >= lo[:, None]) & (matrix[None] <= hi[:, None])
    rows = counts.pair_counts(expr, 0.1).collect()
    assert len(rows) == 90 * 15
    for r in rows:
        assert r.c_ab == (inside[r.cell_id, :, r.a] & inside[r.cell_id, :, r.b]).sum()
    side = lambda g, v: expr.select("module", "cell_id", F.col("gene").alias(g), F.col("value").alias(v))
    points = side("a", "va").join(side("b", "vb"), ["module", "cell_id"]).filter("a < b").groupBy("module", "a", "b", "va", "vb").agg(
        F.count(F.lit(1)).alias("weight"))
    dyadic = {(r.a, r.b, r.va, r.vb): r.members for r in counts.dyadic_pair_counts(neighborhoods.tie_neighborhoods(expr, 0.1), points).collect()}
    assert all(dyadic[r.a, r.b, matrix[r.cell_id, r.a], matrix[r.cell_id, r.b]] == r.c_ab for r in rows)


def test_several_blocks_agree_with_one(spark, matrix, monkeypatch):
    expr = long(spark, matrix)
    whole = counts.pair_count_arrays(expr, 0.1, key_block=4096)
    small = counts.pair_count_arrays(expr, 0.1, key_block=16, member_block=20)
    assert small.exceptAll(whole).count() == 0 and small.count() == 90
    monkeypatch.setattr(counts, "KEY_BLOCK", 7)
    assert counts.pair_count_arrays(expr, 0.1, key_block=50, member_block=33).exceptAll(whole).count() == 0
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.1))
    shares = lambda bits, n, _: (int(counts._tally(bits[0] & bits[1])),)
    held = counts.over_bits(vectors, shares, "both bigint", key_block=16, member_block=20)
    monkeypatch.setattr(counts, "BLOCK_BITS", 90 * 6 * 10)
    tight = counts.over_bits(vectors, shares, "both bigint")
    assert held.exceptAll(tight).count() == 0 and tight.count() == 90
    assert held.select("cell_id", "both").exceptAll(whole.select("cell_id", F.col("both")[0].alias("both"))).count() == 0


def test_subset_counts_over_blocks(spark, matrix):
    expr = long(spark, matrix)
    lo, hi = brute_ranges(matrix, 0.1)
    inside = (matrix[None] >= lo[:, None]) & (matrix[None] <= hi[:, None])
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.1))
    sets = spark.createDataFrame([("all", c, g) for c in range(90) for g in ([], [2], [0, 3], [1, 2, 4, 5])], "module string, cell_id bigint, genes array<int>")
    sets = sets.withColumn("module", F.lit(expr.first()["module"]))
    for r in counts.set_counts(vectors, sets).collect():
        assert r.members == (inside[r.cell_id][:, list(r.genes)].all(axis=1).sum() if len(r.genes) else 90)


def test_nan_ranks_last(spark):
    rows = spark.createDataFrame([(0.5,), (float("nan"),), (-3.0,), (1e300,), (float("inf"),)], "value double")
    ordered = rows.orderBy(ranks.value_chunk(F.col("value")), "value").collect()
    assert [str(r.value) for r in ordered] == ["-3.0", "0.5", "1e+300", "inf", "nan"]


def test_narrow_values_spread_over_chunks(spark):
    rows = spark.range(100_000).select(F.lit("m").alias("module"), F.lit(0).alias("gene"), (F.col("id") + 1.7e9).alias("value"))
    cut = ranks.with_chunks(rows, ["module", "gene"], "value")
    assert cut.select("_chunk").distinct().count() >= 16
    held = cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert held <= 2 * ranks.VALUES_PER_CHUNK
    wrong = ranks.tie_blocks(rows, ["module", "gene"]).filter(F.col("tie_start") != F.col("value") - 1.7e9)
    assert wrong.isEmpty()


def test_hot_blocks_join_apart(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_ROWS", 50)
    monkeypatch.setattr(ranks, "VALUES_PER_CHUNK", 16)
    rng = np.random.default_rng(5)
    x = np.column_stack([np.where(rng.random(400) < 0.9, 0.0, rng.normal(size=400)), rng.normal(size=400)])
    expr = long(spark, x)
    found = {(r.cell_id, r.gene): r.avg_rank for r in ranks.average_rank(expr, ["module", "gene"]).collect()}
    place = {(r.cell_id, r.gene): r.position for r in ranks.ordinal_position(expr, ["module", "gene"]).collect()}
    kept = {(r.cell_id, r.gene): r.profile for r in ranks.zero_preserving_rank(expr, ["module", "gene"]).collect()}
    assert len(found) == len(place) == len(kept) == 800
    for g in (0, 1):
        order = np.lexsort((np.arange(400), x[:, g]))
        positive = np.sort(x[x[:, g] > 0, g])
        for k in range(400):
            below, upto = (x[:, g] < x[k, g]).sum(), (x[:, g] <= x[k, g]).sum()
            assert found[k, g] == (below + upto + 1) / 2
            assert order[place[k, g]] == k
            low, high = np.searchsorted(positive, x[k, g], "left"), np.searchsorted(positive, x[k, g], "right")
            assert kept[k, g] == (pytest.approx((low + high + 1) / 2 / len(positive)) if x[k, g] > 0 else 0.0)


def test_dense_vectors_fill_and_refuse(spark):
    rows = spark.createDataFrame([("m", 1, 1, 2.0), ("m", 1, 4, 5.0), ("m", 2, 0, 1.0)], "module string, cell_id bigint, gene int, value double")
    got = {r.cell_id: list(r.v) for r in correlation.dense_vectors(rows, "cell_id", "gene", "value", 6).collect()}
    assert got == {1: [0.0, 2.0, 0.0, 0.0, 5.0, 0.0], 2: [1.0, 0, 0, 0, 0, 0]}
    with pytest.raises(Exception, match="outside"):
        correlation.dense_vectors(rows, "cell_id", "gene", "value", 4).collect()


def test_tail_probabilities(spark):
    z = [0.0, 0.1, 1.0, 3.5, 3.6, 5.0, 8.0, 30.0, 100.0, -2.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.two_sided_p(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert stats.critical_z(1e-20) == pytest.approx(9.3365, abs=1e-3)


def test_z_score_and_levels(spark):
    row = spark.range(1).select(
        stats.z_score(F.lit(10), F.lit(5), F.lit(5), F.lit(4)).alias("z"),
        stats.independent(F.lit(1), F.lit(1), F.lit(1), F.lit(1), 0.01).alias("one"),
        stats.effective_alpha(0.01, F.lit(0.5), F.lit(None)).alias("a1"),
        stats.effective_alpha(0.01, F.lit(0.5), F.lit(None), gamma=2.0).alias("a2")).first()
    assert row.z == pytest.approx(1.8) and row.one is False
    assert (row.a1, row.a2) == (pytest.approx(0.105), pytest.approx(0.0575))
    p = spark.range(1).select(stats.two_sided_p(F.lit(1.8)).alias("p")).first().p
    assert p == pytest.approx(0.0718606, abs=1e-6)


def test_relational_levels_equal_walk(spark, matrix):
    expr = long(spark, matrix)
    edges, sepsets = skeleton.skeleton_levels(expr, 2, 0.1, 0.05)
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.1))
    walked = skeleton.skeletons(vectors, 0.05, deepest=2)
    assert edges.select("cell_id", "a", "b").exceptAll(skeleton.skeleton_edges(walked).select("cell_id", "a", "b")).count() == 0
    assert edges.count() == skeleton.skeleton_edges(walked).count()
    deep = skeleton.skeleton_sepsets(walked).filter(F.size("sepset") > 0)
    assert sepsets.select("cell_id", "a", "b", "sepset").exceptAll(deep.select("cell_id", "a", "b", "sepset")).count() == 0


def test_constraints_and_raised_levels(spark, matrix):
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(long(spark, matrix), 0.1))
    banned = spark.createDataFrame([("m", 1, 0)], "module string, a int, b int")
    held = spark.createDataFrame([("m", 2, 5)], "module string, a int, b int")
    loose = spark.createDataFrame([("m", a, b, 1.0, -1) for a, b in itertools.combinations(range(6), 2)],
                                  "module string, a int, b int, alpha double, cap int")
    edges = skeleton.skeleton_edges(skeleton.skeletons(vectors, 0.01, forbidden=banned, required=held))
    assert edges.filter("a = 0 and b = 1").count() == 0 and edges.filter("a = 2 and b = 5").count() == 90
    assert skeleton.skeleton_edges(skeleton.skeletons(vectors, 0.01, levels=loose)).count() == 90 * 15


def test_collider_and_extension(spark):
    edges = spark.createDataFrame([("m", 0, 0, 2), ("m", 0, 1, 2), ("m", 0, 2, 3)], "module string, cell_id bigint, a int, b int")
    sepsets = spark.createDataFrame([("m", 0, 0, 1, []), ("m", 0, 0, 3, [2]), ("m", 0, 1, 3, [2])],
                                    "module string, cell_id bigint, a int, b int, sepset array<int>")
    arcs = orientation.collider_edges(edges, sepsets)
    nodes = spark.createDataFrame([("m", 0, 4), ("m", 1, 4)], "module string, cell_id bigint, n_genes int")
    graph = {r.cell_id: r for r in orientation.directed_graphs(arcs, nodes).collect()}
    assert [(e.src, e.dst) for e in graph[0].edges] == [(0, 2), (1, 2), (2, 3)] and not graph[0].fallback
    assert graph[1].edges == []


def test_mixed_graph_fallback():
    graph = orientation.MixedGraph(3, [(0, 1), (1, 2), (2, 0)])
    arcs, stuck = graph.extend()
    assert stuck and arcs == [(0, 1), (1, 2), (2, 0)]


def test_prior_orientation(spark):
    edges = spark.createDataFrame([("m", 0, 0, 1), ("m", 0, 1, 0), ("m", 0, 1, 2)], "module string, cell_id bigint, src int, dst int")
    prior = spark.createDataFrame([("m", 1, 0, 0.5), ("m", 2, 1, 0.2)], "module string, src int, dst int, w double")
    found = {(r.src, r.dst): r.reversed for r in orientation.orient_by_prior(edges, prior).collect()}
    assert found == {(1, 0): True, (2, 1): True}
    kept = {(r.src, r.dst) for r in orientation.orient_mutual_by_prior(edges, prior).collect()}
    assert kept == {(1, 0), (1, 2)}


def test_graph_rows_and_propagation(spark):
    edges = spark.createDataFrame([("m", 0, 0, 1), ("m", 0, 0, 2), ("m", 0, 1, 2)], "module string, cell_id bigint, src int, dst int")
    nodes = spark.createDataFrame([("m", 0, 3)], "module string, cell_id bigint, n_genes int")
    row = graphs.topological_orders(graphs.pack_graphs(edges, nodes)).first()
    assert (row.node_ptr, row.targets, row.topo_order) == ([0, 2, 3, 3], [1, 2, 2], [0, 1, 2])
    assert graphs.decode_graphs(graphs.pack_graphs(edges, nodes)).exceptAll(edges).count() == 0
    beta = spark.createDataFrame([("m", 0, g, float(g + 1)) for g in range(3)], "module string, cell_id bigint, gene int, beta double")
    want = {"sum": [1.2575, 2.15, 3], "mean_out": [1.12875, 2.15, 3], "sym_degree": [1.149461, 2.106066, 3]}
    for mode, values in want.items():
        scores = katz.propagate(katz.edge_coefficients(edges, mode=mode), beta, 0.05).orderBy("gene").collect()
        assert [r.score for r in scores] == pytest.approx(values, abs=1e-6)


def test_cycle_gets_no_order(spark):
    edges = spark.createDataFrame([("m", 0, 0, 1), ("m", 0, 1, 0)], "module string, cell_id bigint, src int, dst int")
    nodes = spark.createDataFrame([("m", 0, 2)], "module string, cell_id bigint, n_genes int")
    assert graphs.topological_orders(graphs.pack_graphs(edges, nodes)).first().topo_order == [-1, -1]


def test_ranks(spark):
    x = np.array([[1.0], [1.0], [5.0]])
    assert sorted(r.avg_rank for r in ranks.average_rank(long(spark, x), ["module", "gene"]).collect()) == [1.5, 1.5, 3.0]
    scaled = {r.cell_id: r.scaled for r in ranks.ordinal_rank_scale(long(spark, np.array([[3.0], [1.0], [2.0]])), ["module", "gene"]).collect()}
    assert scaled == {0: 2.0, 1: 1.0, 2: 1.5}
    q = ranks.quantile(long(spark, np.array([[1.0], [2.0], [4.0]])), ["module", "gene"], 0.95).first().quantile
    assert q == pytest.approx(3.8)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 4))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "cell_id bigint, v array<double>")
    got = {}
    for r in neighbors.nearest_neighbors(vectors, 5, key_block=16, block=20).collect():
        got.setdefault(r.cell_id, {})[r.rank] = r.other
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(70):
        assert [got[i][k] for k in range(1, 6)] == list(np.argsort(d[i])[:5])


def test_motif_strands():
    pssm = np.log2((np.array([[8, 0, 0, 0], [0, 8, 0, 0], [0, 0, 8, 0]]) + 0.5) / 10.0 / 0.25)
    motif = {"matrix": pssm, "min_score": pssm.min(1).sum(), "max_score": pssm.max(1).sum()}
    plus = motifs._best_hit(motifs._encode("TTACGAA"), motif, 0.85)
    assert plus[3] == "+" and plus[2] == 2 and plus[0] == pytest.approx(1.0)
    minus = motifs._best_hit(motifs._encode("TTCGTNN"), motif, 0.85)
    assert minus[3] == "-" and minus[2] == 5
    assert motifs._best_hit(motifs._encode("ANG"), motif, 0.85) is None


def test_factors_of_many_partitions(spark):
    rng = np.random.default_rng(8)
    truth = np.maximum(rng.normal(size=(60, 3)), 0) @ np.maximum(rng.normal(size=(3, 7)), 0)
    far = 2**40  # ids as distributed numbering gives them
    rows = [("m", far * (i % 4) + i, j, float(v)) for i, row in enumerate(truth) for j, v in enumerate(row)]
    values = spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double").repartition(5)
    cells, genes = neighbors.nonnegative_factors(values, 3, tolerance=1e-8)
    w = {r.cell_id: r.v for r in cells.collect()}
    h = np.array([r.v for r in genes.orderBy("gene").collect()])
    placed = np.array([w[far * (i % 4) + i] for i in range(60)])
    assert placed.min() >= 0 and h.min() >= 0
    assert ((truth - placed @ h.T) ** 2).sum() < 0.02 * (truth**2).sum()
    empty, _ = neighbors.nonnegative_factors(values.limit(0), 3)
    assert empty.isEmpty()


def test_truncated_svd_scores(spark):
    x = np.random.default_rng(9).normal(size=(50, 6)) * np.arange(1, 7)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "cell_id bigint, v array<double>")
    got = np.array([r.v for r in neighbors.truncated_svd(table, 4).orderBy("cell_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-6)


def test_long_and_short_intervals(spark):
    rng = np.random.default_rng(12)
    spots = [(i, f"c{i % 2}", int(p)) for i, p in enumerate(rng.integers(0, 2_000_000, 200))]
    spans = [(i, f"c{i % 2}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 2_000_000, 60), [0, 1, 2, 7, 900, 1_000_000] * 10))]
    got = intervals.overlap_join(spark.createDataFrame(spots, "gene_id int, chrom string, pos long"),
                                 spark.createDataFrame(spans, "peak_id int, chrom string, start long, end long"), 1).collect()
    want = sorted((g, p) for g, c, x in spots for p, d, s, e in spans if c == d and s <= x + 1 and e >= x - 1)
    assert sorted((r.gene_id, r.peak_id) for r in got) == want and want


def test_propagation_on_mixed_graphs(spark):
    arcs = {0: [(0, 1, 1.0), (1, 2, 2.0)], 1: [(0, 1, 1.0), (1, 0, 3.0)], 3: [(0, 1, 1.0), (1, 0, 4.0)]}
    edges = spark.createDataFrame([("m", c, *a) for c, part in arcs.items() for a in part], "module string, cell_id bigint, src int, dst int, coef double")
    beta = spark.createDataFrame([("m", c, g, float(c + g + 1)) for c in range(4) for g in range(3)], "module string, cell_id bigint, gene int, beta double")
    score = {(r.cell_id, r.gene): r.score for r in katz.propagate(edges, beta, 0.5).collect()}
    for c in range(4):
        system, b = np.eye(3), np.array([c + 1.0, c + 2.0, c + 3.0])
        for s, d, w in arcs.get(c, []):
            system[s, d] -= 0.5 * w
        want = np.linalg.lstsq(system, b, rcond=None)[0] if c == 3 else np.linalg.solve(system, b)
        assert np.allclose([score[c, g] for g in range(3)], want)


def test_tests_made_in_tasks_are_those_made_as_rows(spark):
    rng = np.random.default_rng(7)
    rows = [("m", c, g, float(v)) for c, line in enumerate(np.cumsum(rng.normal(size=(70, 7)), axis=1)) for g, v in enumerate(line)]
    expr = spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double")
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.3)).cache()
    edges = skeleton.marginal_edges_of(vectors, 0.2).cache()
    assert edges.count()
    for level in (1, 2, 3):
        outcomes = skeleton.level_outcomes(vectors, edges, level, 0.2)
        want = {(r.cell_id, r.a, r.b): list(r.sepset) for r in skeleton.separating_sets(outcomes).collect()}
        got = {(r.cell_id, r.a, r.b): list(r.sepset) for r in skeleton.separated_edges(vectors, edges, level, 0.2).collect()}
        assert got == want
        most = outcomes.groupBy("module", "cell_id").count().agg(F.max("count")).first()[0]
        assert want and skeleton._tests_per_cell(edges, level).first()["load"] == most
    assert skeleton.separated_edges(vectors, edges.limit(0), 1).count() == 0


def _compelled_by_all(n, arcs):
    """Arcs that all acyclic orientations with the same colliders share, by trying every orientation."""
    pairs = sorted({(min(p), max(p)) for p in arcs})
    tied = set(pairs) | {(b, a) for a, b in pairs}
    colliders = lambda g: {(a, c, b) for a, c in g for b, d in g if c == d and a < b and (a, b) not in tied}

    def acyclic(g):
        left = set(range(n))
        while left:
            ends = {v for v in left if not any(s == v and d in left for s, d in g)}
            if not ends:
                return False
            left -= ends
        return True

    wanted = colliders(arcs)
    every = [g for way in itertools.product((0, 1), repeat=len(pairs)) if colliders(g := {(b, a) if w else (a, b) for (a, b), w in zip(pairs, way)}) == wanted and acyclic(g)]
    return set.intersection(*every), wanted


def test_closure_gives_what_the_class_shares(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for cell in range(40):
        n = 5 if cell % 2 else 6
        order = rng.permutation(n)
        dag = {(int(order[i]), int(order[j])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.55}
        if not dag:
            continue
        shared, colliders = _compelled_by_all(n, dag)
        fixed = {(a, c) for a, c, b in colliders} | {(b, c) for a, c, b in colliders}
        pattern = {x for a, b in dag for x in ((a, b), (b, a)) if (x[1], x[0]) not in fixed}
        rows += [("m", cell, s, d) for s, d in pattern]
        want[cell] = {x for a, b in dag for x in ((a, b), (b, a)) if (x[1], x[0]) not in shared}
    arcs = spark.createDataFrame(rows, "module string, cell_id bigint, src int, dst int")
    got = {}
    for r in orientation.close_orientation(arcs.unionByName(arcs.limit(5))).collect():
        got.setdefault(r.cell_id, set()).add((r.src, r.dst))
    assert got == want
    assert orientation.close_orientation(arcs.limit(0)).count() == 0
    both = spark.createDataFrame([(0, 2, 0), (3, 1, 0), (0, 0, 1), (0, 1, 0)], "cell_id bigint, src int, dst int")
    assert {tuple(r) for r in orientation.close_orientation(both).collect()} == {(0, 2, 0), (3, 1, 0), (0, 0, 1)}


def test_links_of_equal_strength_go_by_name(spark):
    gaps = [1000.0 * d for d in range(1, 2000)]
    rows = [(int(g), name, corr, g) for g in gaps for name, corr in (("a", 0.03), ("b", 0.08 - 0.05))] + [(0, "c", 0.5, None)]
    scored = intervals.distal_scores(spark.createDataFrame(rows, "gene_id bigint, peak_id string, corr double, distance double"))
    got = {(r["gene_id"], r["peak_id"]): r["score"] for r in scored.collect()}
    assert got.pop((0, "c")) is None
    assert got == {(int(g), name): corr * math.exp(-g / 200000.0) for g in gaps for name, corr in (("a", 0.03), ("b", 0.08 - 0.05))}


def test_rounds_find_the_same_sets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    expr = long(spark, np.cumsum(rng.normal(size=(120, 9)), axis=1))
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.3)).cache()
    edges = skeleton.marginal_edges_of(vectors, 0.2).cache()
    sets = lambda: sorted((r.cell_id, r.a, r.b, tuple(r.sepset)) for r in skeleton.separated_edges(vectors, edges, 1, 0.2).collect())
    want = sets()
    monkeypatch.setattr(skeleton, "FEW_TESTS", 0)
    for stops in ((1,), (1, 2, 5), (2, 10, 42)):
        monkeypatch.setattr(skeleton, "ROUNDS", stops)
        assert sets() == want and want
    most = edges.groupBy("cell_id").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(counts, "HELD_TESTS", most)  # about one cell a block
    assert sets() == want
