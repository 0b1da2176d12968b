import time

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import counts, neighborhoods, skeleton


def _walks(spark, cells=90, genes=10, seed=4):
    x = np.maximum(np.cumsum(np.random.default_rng(seed).normal(size=(cells, genes)), axis=1), 0.0)
    rows = [("m", c, g, float(v)) for c, line in enumerate(x) for g, v in enumerate(line)]
    return spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double").repartition(2)


def test_points_between_over_several_blocks():
    rng = np.random.default_rng(1)
    for m in (0, 1, 65, 4096, 9000):
        seq = rng.permutation(m).astype(np.int32)
        corner = np.sort(rng.integers(0, m + 1, 200)).astype(np.int32)
        low = rng.integers(0, m + 1, 200).astype(np.int32)
        high = np.minimum(low + m // 3, m).astype(np.int32)
        want = [((seq[:c] >= a) & (seq[:c] < b)).sum() for c, a, b in zip(corner, low, high)]
        assert counts._points_between(seq, corner, low, high).tolist() == want


def test_points_between_costs_little_more_than_a_sort():
    rng = np.random.default_rng(2)
    seq = rng.permutation(2**20).astype(np.int32)
    corner = np.sort(rng.integers(0, len(seq) + 1, 4096)).astype(np.int32)
    low, took = np.full_like(corner, 5), {}
    for _ in range(3):
        for name, work in (("sort", lambda: seq.argsort()), ("count", lambda: counts._points_between(seq, corner, low, corner))):
            start = time.process_time()
            work()
            took[name] = min(took.get(name, np.inf), time.process_time() - start)
    assert took["count"] < 5 * took["sort"]  # blocks that pass over all members took 9 times a sort


def test_pair_counts_in_several_passes_over_members(spark):
    expr = _walks(spark)
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.1))
    bits = counts.pair_count_arrays(expr, 0.1)
    start = {(a, b): at for at, (a, b) in enumerate(counts.all_pairs(10))}
    want = {(r.cell_id, a, b): (r.single[a], r.single[b], r.both[at]) for r in bits.collect() for (a, b), at in start.items()}
    for limits in ({}, {"key_cells": 40, "member_cells": 25}):
        got = {(r.cell_id, r.a, r.b): (r.c_a, r.c_b, r.c_ab) for r in counts.over_pairs(vectors, **limits).collect()}
        assert got == want
    some = counts.over_pairs(vectors, lambda n, c_a, c_b, c_ab: c_ab > 5, lambda genes: [(0, genes - 1)])
    assert {(r.cell_id, r.a, r.b) for r in some.collect()} == {k for k, v in want.items() if k[1:] == (0, 9) and v[2] > 5}


def test_levels_give_the_graphs_of_the_walk(spark):
    expr = _walks(spark, 70, 7, 7)
    vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, 0.3))
    differ = []
    for stable in (True, False):
        walked = skeleton.skeletons(vectors, 0.2, stable=stable)
        want = {tuple(r) for r in skeleton.skeleton_edges(walked).select("cell_id", "a", "b").collect()}
        sets = {(r.cell_id, r.a, r.b): list(r.sepset) for r in skeleton.skeleton_sepsets(walked).collect() if r.sepset}
        edges, found = skeleton.full_skeletons(expr, 20, 0.3, 0.2, stable)
        assert {tuple(r) for r in edges.select("cell_id", "a", "b").collect()} == want
        assert {(r.cell_id, r.a, r.b): list(r.sepset) for r in found.collect()} == sets
        differ.append(want)
    assert max(map(len, sets.values())) > 1 and differ[0] != differ[1]


def test_path_counts_are_those_of_the_sets_of_level_one(spark):
    expr = _walks(spark, 130, 9, 5)
    vectors = counts.placed_vectors(expr, 0.2).cache()
    tests = skeleton.level_tests(skeleton.marginal_edges_of(vectors, 0.05), 1)
    triples = tests.select("module", "cell_id", F.array_sort(F.concat(F.array("a", "b"), "zs")).alias("genes"))
    want = {(r.cell_id, *r.genes, r.members) for r in counts.set_counts(vectors, triples).collect()}
    linked = skeleton.marginal_masks(vectors, 0.05)
    rows = lambda linked: [(r.cell_id, r.g0, r.g1, r.g2, r.members) for r in counts.path_counts(vectors, linked).collect()]
    got = rows(linked)
    assert set(got) == want and len(got) == len(want) > 1000
    assert set(rows(linked.filter("cell_id = 7"))) == {r for r in want if r[0] == 7}


def test_paths_meet_the_members_near_them_alone(monkeypatch):
    rng = np.random.default_rng(3)
    n, genes = 1500, 6
    own = np.stack([rng.permutation(n) for _ in range(genes)], axis=1).astype(np.int32)
    own[own[:, 0] < 400, 0] = 0  # a large tie block
    lo, hi = np.maximum(own - 100, 0), np.minimum(own + 100, n - 1)
    masks = rng.integers(0, 2**63, (n, 1))
    monkeypatch.setattr(counts, "PREFIX_BLOCK", 128)
    met, real = [], np.searchsorted
    cells, made, first, rows, keys = counts._sets_of(np.arange(n), np.stack((lo, hi)), masks, genes, 0)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: (met.append(np.size(v)), real(a, v, *more))[1])
    counts._add_paths(made, first, rows, keys, own)
    assert sum(met) < 0.6 * 2 * genes * n * -(-n // 128)
    key, y = np.divmod(rows[0], genes)
    z = rows[1] - key * genes
    for at in rng.integers(0, len(key), 200):
        cell = cells[key[at]]
        inside = [(own[:, g] >= lo[cell, g]) & (own[:, g] <= hi[cell, g]) for g in (0, y[at], z[at])]
        assert made[at] == (inside[0] & inside[1] & inside[2]).sum()
