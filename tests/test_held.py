"""Work on the packed members of one cell at a time, and what follows on linked rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import counts, graphs, neighborhoods, orientation, skeleton
from netloom.plans.catalog import QUERIES


def _walks(spark, cells, genes, seed, modules=("m",)):
    rng = np.random.default_rng(seed)
    rows = []
    for k, module in enumerate(modules):
        values = np.maximum(np.cumsum(rng.normal(size=(cells + 9 * k, genes + k)), axis=1).round(2), 0.0)
        rows += [(module, c, g, float(v)) for c, line in enumerate(values) for g, v in enumerate(line)]
    return spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double")


def _vectors(expr, fraction):
    return counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, fraction)).cache()


def _members(vectors):
    """(module, cell) to a boolean (genes, members) table, worked out value by value."""
    found, rows = {}, vectors.collect()
    for module in {r.module for r in rows}:
        own = np.array([r.own for r in rows if r.module == module])
        found |= {(module, r.cell_id): ((own >= r.lo) & (own <= r.hi)).T for r in rows if r.module == module}
    return found


def test_members_are_packed_in_blocks_and_from_the_file(monkeypatch):
    rng = np.random.default_rng(2)
    own = rng.integers(0, 400, (1000, 5)).astype(np.int32)
    lo = rng.integers(0, 400, (30, 5)).astype(np.int32)
    hi = lo + rng.integers(-5, 200, lo.shape).astype(np.int32)  # some are inverted
    want = ((own[None] >= lo[:, None]) & (own[None] <= hi[:, None])).sum(1)
    monkeypatch.setattr(counts, "COMPARED", 128)
    for held in (2**26, 3 * 128 * 5, 0):
        monkeypatch.setattr(counts, "HELD_STARTS", held)
        members = counts._Members(5)
        for low in range(0, 1000, 70):
            members.add(own[low : low + 70])
        assert len(members.held) == min(7, held // 640) and members.stored == 7 - len(members.held)
        for _ in range(2):
            assert (np.bitwise_count(members.pack(lo, hi)).sum(2) == want).all()


def test_shared_counts_are_those_of_the_members(monkeypatch):
    rng = np.random.default_rng(4)
    inside = rng.random((6, 1000)) < 0.5
    bits = np.packbits(np.pad(inside, ((0, 0), (0, 24))), axis=1).view(np.uint64)
    sets = rng.integers(0, 6, (4, 500))
    want = [np.logical_and.reduce(inside[list(s)]).sum() for s in sets.T]
    for room, known in ((2**15, 2**22), (1, 2**22), (64, 0)):
        monkeypatch.setattr(counts, "ROOM", room)
        monkeypatch.setattr(counts, "KNOWN_SETS", known)
        shared = counts.SharedCounts(bits)
        assert (shared.of(*sets) == want).all() and (shared.of(*sets[:, ::-1]) == want[::-1]).all()
        assert (shared.single == inside.sum(1)).all()


def test_triples_and_single_tests_are_counted_where_cells_are_packed(spark, monkeypatch):
    vectors = _vectors(_walks(spark, 150, 7, 5, ("m", "k")), 0.2)
    inside = _members(vectors)
    monkeypatch.setattr(counts, "PACKED_WORDS", 50)
    masks = skeleton.marginal_masks(vectors, 0.1)
    near = {}
    for r in skeleton.marginal_edges_of(vectors, 0.1).collect():
        near.setdefault((r.module, r.cell_id), set()).update(((r.a, r.b), (r.b, r.a)))
    got = [tuple(r) for r in counts.triple_counts(vectors, masks).collect()]
    want = {(*cell, x, y, z) for cell, p in near.items() for x in range(8) for y in range(x + 1, 8) for z in range(y + 1, 8)
            if ((x, y) in p) + ((x, z) in p) + ((y, z) in p) > 1}
    assert {r[:5] for r in got} == want and len(got) == len(want) > 1000
    for r in got[:300]:
        assert r[5] == inside[r[:2]][list(r[2:5])].all(0).sum()
    rows = skeleton.level_outcomes(vectors, skeleton.marginal_edges_of(vectors, 0.1), 1, 0.1)
    four = ("c_z", "c_xz", "c_yz", "c_xyz", "separates")
    rows = rows.select("module", "cell_id", "a", "b", F.get("zs", F.lit(0)).alias("given"), F.get("turn", F.lit(0)).alias("pool"), *four)
    assert sorted(map(tuple, skeleton.single_outcomes(vectors, 0.1).select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("stable", (True, False))
def test_skeletons_of_one_row_a_cell_are_those_of_the_levels(spark, monkeypatch, stable):
    vectors = _vectors(_walks(spark, 140, 8, 6, ("m", "k")), 0.3)
    edges = skeleton.marginal_edges_of(vectors, 0.1).cache()
    found = skeleton.separated_edges(vectors, edges, 1, 0.1, stable)
    want = {(*r[:4], r.sepset[0]) for r in found.collect()}
    left = {tuple(r) for r in edges.collect()} - {r[:4] for r in want}
    for tried, turn in (((2, 8, 32), 64), ((1,), 3), ((), 1)):
        monkeypatch.setattr(skeleton, "TRIED", tried)
        monkeypatch.setattr(skeleton, "IN_TURN", turn)
        e, f = skeleton.linked_rows(skeleton.single_skeletons(vectors, 0.1, stable))
        assert {(*r[:4], r.sepset[0]) for r in f.collect()} == want and want
        assert {tuple(r) for r in e.collect()} == left and left


def test_linked_arcs_are_those_of_the_joins(spark):
    vectors = _vectors(_walks(spark, 140, 8, 6, ("m", "k")), 0.3)
    cells = skeleton.single_skeletons(vectors, 0.1)
    arcs = orientation.collider_edges(*skeleton.linked_rows(cells)).cache()
    linked = orientation.collider_linked(cells)
    every = lambda df: sorted(map(tuple, df.collect()), key=str)
    rows = lambda df: every(graphs.linked_edges(df).select(arcs.columns))
    assert rows(linked) == every(arcs) and arcs.count() > 100
    assert rows(orientation.directed_linked(linked)) == every(graphs.directed_only(arcs))
    assert rows(orientation.mutual_linked(linked)) == every(graphs.mutual_only(arcs)) != []
    rng = np.random.default_rng(1)
    prior = spark.createDataFrame([("m", s, d, float(rng.integers(1, 4))) for s in range(8) for d in range(8) if s != d and rng.random() < 0.5], "module string, src int, dst int, w double")
    for orient in (orientation.orient_by_prior, orientation.orient_mutual_by_prior, orientation.orient_acyclic_by_prior):
        assert every(orient(linked, prior)) == every(orient(arcs, prior)) != []


def test_level_one_queries_store_no_edge_or_member_for_each_block(spark, monkeypatch, tmp_path):
    """What level 1 shuffles must not grow with its tests: no edge of level 0 is a row, and members go to a fixed number of tasks."""
    rng = np.random.default_rng(9)
    table = [(i, [float(x) for x in line], 0) for i, line in enumerate(np.cumsum(rng.normal(size=(90, 6)), axis=1))]
    spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def refuse(*_, **__):
        raise AssertionError("rows of edges or members for each key block")

    for module, name in ((skeleton, "marginal_edges_of"), (skeleton, "over_counts"), (counts, "over_counts"), (counts, "path_counts")):
        monkeypatch.setattr(module, name, refuse)
    monkeypatch.setattr(skeleton, "over_bits", refuse)
    level = ("skeleton_l1", "sepsets_l1", "collider_edges", "orient_totals", "count_triple", "ci_level1", "cell_graph_summary", "score_full")
    rows = {name: QUERIES[name](spark, str(tmp_path)).count() for name in level}
    assert rows["collider_edges"] > 0 and rows["orient_totals"] == 1 and rows["cell_graph_summary"] == 90 and rows["score_full"] == 540
    assert rows["ci_level1"] > rows["count_triple"] > 0 and rows["sepsets_l1"] > 0


@pytest.mark.parametrize("stable", (True, False))
def test_full_skeletons_go_on_where_a_cell_was_packed(spark, stable):
    expr = _walks(spark, 90, 8, 12, ("m", "k"))
    vectors = _vectors(expr, 0.3)
    walked = skeleton.skeletons(vectors, 0.2, stable=stable)
    cells = skeleton.linked_full_skeletons(expr, 20, 0.3, 0.2, stable).cache()
    edges, found = skeleton.linked_rows(cells)
    every = lambda df: sorted(map(tuple, df.collect()))
    assert every(edges) == every(skeleton.skeleton_edges(walked)) != []
    sets = skeleton.skeleton_sepsets(walked).filter(F.size("sepset") > 0)
    assert every(found) == every(sets) and found.filter(F.size("sepset") > 1).count()
    arcs = orientation.collider_edges(edges, found).cache()
    linked = orientation.collider_linked(cells)
    assert every(graphs.linked_edges(linked).select(arcs.columns)) == every(arcs)
    nodes = vectors.select("module", "cell_id", F.size("own").alias("n_genes"))
    same = lambda df: {(r.module, r.cell_id): (sorted(map(tuple, r.edges)), r.fallback) for r in df.collect()}
    assert same(orientation.directed_graphs(linked, nodes)) == same(orientation.directed_graphs(arcs, nodes))


def test_rules_pass_over_nodes_without_arcs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        arcs = [(s, d) for s in range(6) for d in range(6) if s != d and rng.random() < 0.3]
        small, large = orientation.MixedGraph(6, arcs), orientation.MixedGraph(60, [(9 * s + 2, 9 * d + 2) for s, d in arcs])
        seen = []
        large.reaches, reaches = lambda s, d: seen.append((s, d)) or reaches(s, d), large.reaches
        small.propagate(True)
        large.propagate(True)
        edges, stuck = small.extend()
        assert large.extend() == ([(9 * s + 2, 9 * d + 2) for s, d in edges], stuck)
        assert all(s % 9 == 2 and d % 9 == 2 for s, d in seen)
    empty = orientation.MixedGraph(4000, [])
    empty.propagate(False)  # pairs of nodes without arcs, 16 million, are not looked at
    assert empty.extend() == ([], False)
