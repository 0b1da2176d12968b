"""Graphs as one row per cell against their edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import counts, graphs, katz, orientation, skeleton


def _linked(spark, sets, nodes):
    rows = [(m, c, nodes, [s for s, _ in sorted(e)], [d for _, d in sorted(e)]) for (m, c), e in sets.items()]
    return spark.createDataFrame(rows, "module string, cell_id bigint, n_genes int, src array<int>, dst array<int>")


def _random(seed, cells, nodes, share, upper=True):
    rng = np.random.default_rng(seed)
    pairs = [(s, d) for s in range(nodes) for d in range(nodes) if (s < d if upper else s != d)]
    return {("mn"[c % 2], c): {p for p in pairs if rng.random() < share} for c in range(cells)}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("nodes,share", [(9, 0.3), (9, 0.7), (70, 0.04)])
def test_closure_of_rows_is_that_of_edges(spark, nodes, share):
    linked = _linked(spark, _random(nodes, 5, nodes, share), nodes)
    rng = np.random.default_rng(3)
    gone = [(m, int(s), int(d)) for m in "mn" for s, d in {tuple(rng.integers(0, nodes, 2)) for _ in range(nodes)} if s != d]
    gone = spark.createDataFrame([g for g in gone if (g[0], g[2], g[1]) not in gone], "module string, src int, dst int")
    arcs = orientation.both_ways(graphs.linked_edges(linked).withColumnsRenamed({"src": "a", "dst": "b"})).join(gone, ["module", "src", "dst"], "left_anti")
    got = orientation.close_linked(linked, gone)
    assert _rows(got.select("module", "cell_id", "src", "dst")) == _rows(orientation.close_orientation(arcs).select("module", "cell_id", "src", "dst"))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()  # not all cells of a module in one task
    assert orientation.close_linked(linked).count() == 2 * graphs.linked_edges(linked).count()


@pytest.mark.parametrize("nodes,share", [(6, 0.25), (67, 0.02)])
def test_paths_of_rows(spark, nodes, share):
    sets = _random(5, 4, nodes, share, upper=False) | {("m", 9): set()}  # with cycles, and a graph without edges
    want = []
    for (m, c), edges in sets.items():
        step = np.zeros((nodes, nodes), int)
        for s, d in edges:
            step[s, d] = 1
        reach = step.copy()
        for _ in range(nodes):
            reach = ((reach + reach @ step) > 0).astype(int)
        want += [(m, c, int(s), int(d)) for s, d in zip(*np.nonzero(reach))]
    assert _rows(graphs.successor_closure(_linked(spark, sets, nodes))) == sorted(want)


def test_packing_and_coefficients_of_rows(spark):
    linked = _linked(spark, _random(8, 6, 7, 0.4) | {("m", 9): set()}, 7)
    edges, nodes = graphs.linked_edges(linked), linked.select("module", "cell_id", "n_genes")
    assert _rows(graphs.pack_linked(linked)) == _rows(graphs.pack_graphs(edges, nodes))
    assert _rows(graphs.decode_graphs(graphs.pack_linked(linked))) == _rows(edges)
    weights = spark.createDataFrame([("m", 0, 1, 0.5), ("m", 2, 40, 1.0), ("m", 1, 3, -1.0), ("n", 1, 2, 2.0)], "module string, src int, dst int, w double")
    for mode in ("sum", "mean_out", "sym_degree"):
        for known in (None, weights):
            round_off = lambda df: _rows(df.select("module", "cell_id", "src", "dst", F.round("coef", 9)))
            got = katz.linked_coefficients(linked, known, 2.0, mode)
            assert round_off(graphs.linked_edges(got, "coef")) == round_off(katz.edge_coefficients(edges, known, 2.0, mode))
    with pytest.raises(ValueError):
        katz.linked_coefficients(linked, weights, 2.0, "none")


@pytest.mark.parametrize("genes", [5, 19])
def test_marginal_graphs_are_the_marginal_edges(spark, genes):
    rng = np.random.default_rng(genes)
    base = rng.normal(size=(80, 3)) @ rng.normal(size=(3, genes)) + 0.3 * rng.normal(size=(80, genes))
    expr = spark.createDataFrame([("m", c, g, float(max(v, 0))) for c, row in enumerate(base) for g, v in enumerate(row)], "module string, cell_id bigint, gene int, value double")
    expr = expr.unionByName(expr.filter(f"gene < {genes - 2}").withColumn("module", F.lit("n")))  # modules of different width
    nodes = expr.select("module", "cell_id").distinct().withColumn("n_genes", F.lit(genes)).unionByName(
        spark.createDataFrame([("m", 500, genes)], "module string, cell_id bigint, n_genes int"))
    found = skeleton.marginal_graphs(expr, nodes)
    assert found.count() == 161 and found.filter("cell_id = 500 and size(src) = 0").count() == 1
    want = _rows(skeleton.marginal_edges(expr))
    assert _rows(graphs.linked_edges(found)) == want and want


def test_masks_hold_every_pair():
    for genes in (2, 8, 9, 64):
        units = counts._units(counts.all_pairs(genes))
        every = np.array([[(1 << len(unit)) - 1 for unit, _ in units]], np.uint64).view(np.int64)
        row, a, b = counts.mask_pairs(every, genes)
        assert list(zip(a.tolist(), b.tolist())) == counts.all_pairs(genes) and not row.any()


def test_tests_are_told_apart_cell_by_cell():
    """Making the tests of a block takes far less memory than their sets written out, with the counts of all sets at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    sizes, genes = np.array([6000, 0, 1, 25000, 9000] * 10), 20
    ends = np.sort(rng.integers(0, genes, (sizes.sum(), 2)), axis=1).astype(np.int32)
    given = rng.integers(0, genes, (len(ends), 1)).astype(np.int32)
    tracemalloc.start()
    tests = counts.Tests(ends[:, 0], ends[:, 1], given, sizes, genes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(ends)  # nearly 300 before, and as many for any number of tests
    bits = rng.integers(0, 2**63, (len(sizes), genes, 2), dtype=np.uint64)
    tests.add(slice(0, 23), bits[:23])
    tests.add(slice(23, 50), bits[23:])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    z, x, y = bits[owner, given[:, 0]], bits[owner, ends[:, 0]], bits[owner, ends[:, 1]]
    want = np.stack([counts._tally(c) for c in (z, z & x, z & y, z & x & y)], axis=1)
    assert (tests.counts == want).all()
    assert (np.concatenate([four for _, four in tests.parts()], axis=1).T == want).all()


def test_profiles_are_made_once(spark):
    from netloom.plans.catalog import QUERIES

    made = QUERIES["joint_profiles"](spark, "/root/testdata/sf0.001")
    assert made.count() and not any("lineitem" in f for f in made.inputFiles())  # the lines were added up again for the last join
