"""Undirected skeletons, one per cell, by conditional independence.

``single_skeletons`` makes the tests given one gene where a cell's bits are packed, a few candidates of every open edge at a
time, and gives one row a cell.  ``skeleton_levels`` adds larger sets level by level: the tasks that hold a cell's running counts
make its tests and give the verdicts, and separated edges are removed by an anti join.  ``level_outcomes`` gives all tests of a
level as rows, with their counts, ``single_outcomes`` those of level 1 without ever storing them.  ``skeletons`` walks all levels in one pass over the packed bits of a key block and stops at the
first separating set, which no relational plan can do across rows.  ``linked_full_skeletons`` walks on from single genes.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import chain, combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, written
from ..functions.stats import EPSILON, critical_z, independent
from .counts import CELL, KEY_BLOCK, SharedCounts, Tests, cell_vectors, mask_pairs, near_of, over_bits, over_cells, over_counts, over_pairs, test_counts
from .graphs import list_of, list_parts, over_rows
from .neighborhoods import cell_neighborhoods

EDGE = (*CELL, "a", "b")
TRIED = (1, 2, 4, 8, 16, 32)  # candidates of an open edge that are tried at a time; all others after these
IN_TURN = 64  # edges tried at a time where each changes the pools of the ones after it
ROUNDS, FEW_TESTS = (2, 10, 42), 2**24  # candidates an edge has had after each round; tests that are made in one


def marginal_edges_of(vectors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Level 0 from cell vectors: counts and verdict stay in the task, only edges leave it."""
    limit = critical_z(alpha)
    return over_pairs(vectors, lambda n, c_a, c_b, c_ab: _scores(n, c_a, c_b, c_ab) >= limit).select(*EDGE)


def marginal_edges(expr: DataFrame, fraction: float = 0.1, alpha: float = 0.01) -> DataFrame:
    """Level 0: gene pairs a < b whose neighbourhoods depend on each other, per cell."""
    return marginal_edges_of(cell_vectors(cell_neighborhoods(expr, fraction)), alpha)


def marginal_masks(vectors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Level 0 as (module, cell_id, genes, masks): one word per two gene tiles, with a bit for each of their pairs."""
    limit = critical_z(alpha)
    kept = over_pairs(vectors, lambda n, c_a, c_b, c_ab: _scores(n, c_a, c_b, c_ab) >= limit, masks=True)
    words = kept.groupBy(*CELL, "genes").agg(F.array_sort(F.collect_list(F.struct("unit", "mask"))).alias("_m"))
    return words.select(*CELL, "genes", F.col("_m.mask").alias("masks"))


def marginal_graphs(expr: DataFrame, nodes: DataFrame, fraction: float = 0.1, alpha: float = 0.01) -> DataFrame:
    """Level 0 as linked graphs: (module, cell_id, n_genes, src, dst) for every one of ``nodes`` (module, cell_id, n_genes).

    Verdicts leave the counting tasks as one word per cell and two gene tiles and meet by cell, so that no edge is ever
    shuffled or stored; they become edges row by row, where they are read.
    """
    joined = written(nodes.join(marginal_masks(cell_vectors(cell_neighborhoods(expr, fraction)), alpha), list(CELL), "left"))

    def unpack(batch: pa.RecordBatch) -> list[pa.Array]:
        row, flat = list_parts(batch.column("masks"))
        genes = batch.column("genes").fill_null(0).to_numpy(zero_copy_only=False)
        found = []
        for n in np.unique(genes[genes > 1]):
            own = np.flatnonzero(genes == n)
            at, a, b = mask_pairs(flat[genes[row] == n].reshape(len(own), -1), int(n))
            found.append((own[at], a, b))
        row, a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable") if len(found) > 1 else slice(None)
        return [list_of(row[order], end[order].astype(np.int32), batch.num_rows) for end in (a, b)]

    return over_rows(joined, unpack, "src array<int>, dst array<int>", ("genes", "masks"))


def neighbor_pools(edges: DataFrame) -> DataFrame:
    """Edges with the sorted neighbours of either end, the other end left out."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                   F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    near = (
        edges.select(*CELL, F.inline(ends))
        .groupBy(*CELL, "node")
        .agg(F.array_sort(F.collect_list("other")).alias("near"))
    )
    side = lambda end: near.select(*CELL, F.col("node").alias(end), F.col("near").alias(f"near_{end}"))
    return (
        edges.join(side("a"), [*CELL, "a"])
        .join(side("b"), [*CELL, "b"])
        .select(*EDGE,
                F.array_remove("near_a", F.col("b")).alias("pool_a"),
                F.array_remove("near_b", F.col("a")).alias("pool_b"))
    )


def combinations_of(df: DataFrame, pool: str, size: int, out: str = "zs", turn: str = "turn") -> DataFrame:
    """Rows for all ``size``-subsets of a sorted array, lexicographic by ``turn``."""
    n = F.size(pool)
    df = df.withColumn(turn, F.array().cast("array<int>"))
    for step in range(size):
        first = F.lit(0) if step == 0 else F.element_at(turn, -1) + 1
        last = n - (size - step)
        steps = F.when(first <= last, F.sequence(first, last))
        df = df.withColumn("_next", F.explode(steps)).withColumn(turn, F.concat(turn, F.array("_next"))).drop("_next")
    return df.withColumn(out, F.transform(turn, lambda i: F.get(pool, i)))


def level_tests(edges: DataFrame, level: int) -> DataFrame:
    """Candidate separating sets of ``level`` genes: the pool of a first, then that of b."""
    pools = neighbor_pools(edges)
    sides = [
        combinations_of(pools, pool, level)
        .select(*EDGE, "zs", F.concat(F.array(F.lit(rank)), "turn").alias("turn"))
        for rank, pool in enumerate(("pool_a", "pool_b"))
    ]
    return sides[0].unionByName(sides[1])


def level_outcomes(vectors: DataFrame, edges: DataFrame, level: int, alpha: float = 0.01) -> DataFrame:
    """All tests of a level with their counts and verdict."""
    counted = test_counts(vectors, level_tests(edges, level))
    verdict = independent(F.col("c_z"), F.col("c_xz"), F.col("c_yz"), F.col("c_xyz"), alpha)
    return counted.withColumn("separates", verdict)


def separating_sets(outcomes: DataFrame) -> DataFrame:
    """The first separating set of every edge that has one."""
    return outcomes.filter("separates").groupBy(*EDGE).agg(F.min_by("zs", "turn").alias("sepset"))


def _tests_per_cell(edges: DataFrame, level: int) -> DataFrame:
    """(module, load, tests): the most tests of a level that a cell of the module has, and those of all its cells.

    An edge end with d edges gives each of them a pool of d - 1 genes, so degrees tell the number of subsets.
    """
    subsets = F.lit(1.0)
    for k in range(level):
        subsets = subsets * F.greatest(F.col("d") - 1 - k, F.lit(0)) / (k + 1)
    degrees = edges.select(*CELL, F.explode(F.array("a", "b")).alias("node")).groupBy(*CELL, "node").agg(F.count(F.lit(1)).alias("d"))
    return degrees.groupBy(*CELL).agg(F.sum(F.col("d") * subsets).alias("own")).groupBy("module").agg(F.max("own").alias("load"), F.sum("own").alias("tests"))


def _single_tests_of(head: dict, genes: int, start: int, stop: int) -> tuple[Tests, np.ndarray, np.ndarray, np.ndarray]:
    """Tests given one gene of a block's open edges, from place ``start`` of their candidates on and before ``stop``: the pool of a,
    then that of b.  Also the edge of each test, the end whose pool it takes, and how many candidates each edge has left."""
    offsets = np.concatenate(([0], np.cumsum(head["a"].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    a, b = (head[end].flatten().to_numpy(zero_copy_only=False).astype(np.int32) for end in ("a", "b"))
    cell = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    edges = np.arange(len(a))
    if "left" in head:
        owner = np.repeat(np.arange(len(offsets) - 1), head["left"].value_lengths().to_numpy(zero_copy_only=False))
        edges = offsets[owner] + head["left"].flatten().to_numpy(zero_copy_only=False)
    more, found = np.zeros(len(a), np.int64), [(np.zeros(0, np.int32),) * 3]
    step = max(1, 2**18 // genes**2)  # cells whose links are held as tables
    for low in range(0, len(offsets) - 1, step):
        every = slice(offsets[low], offsets[min(low + step, len(offsets) - 1)])
        near = np.zeros((step, genes, genes), bool)
        near[cell[every] - low, a[every], b[every]] = near[cell[every] - low, b[every], a[every]] = True
        e = edges[np.searchsorted(edges, every.start) : np.searchsorted(edges, every.stop)]
        pools = np.concatenate((near[cell[e] - low, a[e]], near[cell[e] - low, b[e]]), axis=1)
        pools[np.arange(len(e)), b[e]] = pools[np.arange(len(e)), genes + a[e]] = False
        place = np.cumsum(pools, axis=1, dtype=np.int32)
        more[e] = np.maximum(place[:, -1] - stop, 0)
        at, column = np.nonzero(pools & (place > start) & (place <= stop))
        found.append((e[at].astype(np.int32), (column % genes).astype(np.int32), np.where(column < genes, a[e[at]], b[e[at]])))
    edge, given, ends = (np.concatenate(c) for c in zip(*found))
    sizes = np.bincount(cell[edge], minlength=len(offsets) - 1)
    return Tests(a[edge], b[edge], given[:, None], sizes, genes), edge, ends, more


@lru_cache(maxsize=1024)
def _choices(n: int, size: int) -> np.ndarray:
    """Places of all subsets of a pool of n, in lexicographic order."""
    return np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)


def _level_tests_of(lists: tuple[pa.Array, pa.Array], genes: int, level: int) -> tuple[Tests, np.ndarray, np.ndarray]:
    """All tests of a block's edges: for each edge the subsets of the pool of a, then those of b; the edge of each test and
    the end whose pool it takes."""
    offsets = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    a, b = (end.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for end in lists)
    given, of, sizes = [], [], []
    for low, high in zip(offsets, offsets[1:]):
        near = np.zeros((genes, genes), bool)
        near[a[low:high], b[low:high]] = near[b[low:high], a[low:high]] = True
        pools = [np.flatnonzero(row) for row in near]
        count = 0
        for e in range(low, high):
            for end, other in ((a[e], b[e]), (b[e], a[e])):
                pool = pools[end]
                sets = pool[pool != other][_choices(len(pool) - 1, level)]
                given.append(sets)
                of.append((e, len(sets), end))
                count += len(sets)
        sizes.append(count)
    each, times, ends = np.array(of, np.int64).reshape(-1, 3).T
    edge = np.repeat(each, times)
    rows = np.concatenate(given) if given else np.zeros((0, level), np.int64)
    return Tests(a[edge], b[edge], rows, np.array(sizes, np.int64), genes), edge, np.repeat(ends, times)


def _in_turn(tests: Tests, ends: np.ndarray, hits: np.ndarray, lists: tuple[pa.Array, pa.Array], genes: int) -> np.ndarray:
    """The separating tests that count if an edge leaves its ends' pools as soon as it is separated.

    Pools only shrink, and leaving genes out keeps the order of the subsets left: of an edge's tests the first one counts that
    separates and whose given genes all are still neighbours of the end.
    """
    kept, owner, near = [], -1, np.zeros((genes, genes), bool)
    for hit in hits:
        if tests.owner[hit] != owner:
            owner = tests.owner[hit]
            near[:] = False
            a, b = (end[owner].values.to_numpy() for end in lists)
            near[a, b] = near[b, a] = True
        a, b = tests.a[hit], tests.b[hit]
        if near[a, b] and near[ends[hit], tests.given[hit]].all():
            near[a, b] = near[b, a] = False
            kept.append(hit)
    return np.array(kept, np.int64)


def separated_edges(vectors: DataFrame, edges: DataFrame, level: int, alpha: float = 0.01, stable: bool = True) -> DataFrame:
    """(module, cell_id, a, b, sepset): the first separating set of ``level`` genes of every edge that has one.

    A cell's edges go to its key block, which makes the tests, adds up their counts while member blocks stream by, and gives
    the verdicts; no test is ever a row.  Blocks are sized by tests.  A cell's own tests of one level stay together.  If not
    ``stable``, edges are taken one after another and those separated leave the pools of the ones after them.

    Most edges fall to one of their first candidates.  Where there are many tests, single genes are therefore tried in rounds, a
    few candidates of every edge that is still open at a time; an edge leaves with its first separating gene, as it would anyway.
    """
    limit = critical_z(alpha)
    near = F.array_sort(F.collect_list(F.struct("a", "b")))
    lists = written(edges.groupBy(*CELL).agg(near.alias("_e")).select(*CELL, F.col("_e.a").alias("a"), F.col("_e.b").alias("b")))
    load = cut_lineage(_tests_per_cell(edges, level))
    stops = [None]
    if level == 1 and stable and (load.agg(F.sum("tests")).first()[0] or 0) > FEW_TESTS:
        stops = [*ROUNDS, None]
    columns = "a array<int>; b array<int>; sepset array<array<int>>; left array<int>; more bigint"
    rounds, asked, start = [], lists, 0
    for stop in stops:
        if start:
            asked = lists.join(rounds[-1].filter("size(left) > 0").select(*CELL, "left", "more"), list(CELL))
        if stop is not None or start:
            some = F.size("left" if start else "a") * F.lit((stop or 2**31) - start).cast("bigint")
            own = F.least(some, "more") if start else some
            load = cut_lineage(asked.groupBy("module").agg(F.sum(own).alias("tests")))
        begin, finish = _verdicts(level, start, stop or 2**31 - 1, limit, stable)
        rounds.append(written(over_counts(vectors, begin, lambda made, keys, bits: made[0].add(keys, bits), finish, columns, asked, load=load)))
        start = stop
        if start and rounds[-1].filter("size(left) > 0").isEmpty():
            break
    return reduce(DataFrame.unionByName, [found.select(*CELL, F.inline(F.arrays_zip("a", "b", "sepset"))) for found in rounds])


def _verdicts(level: int, start: int, stop: int, limit: float, stable: bool):
    """The first and the last step of ``over_counts`` for the tests of a level."""
    def begin(head: dict, genes: int) -> tuple:
        if level == 1:
            return _single_tests_of(head, genes, start, stop)
        return *_level_tests_of((head["a"], head["b"]), genes, level), None

    def finish(made: tuple, head: dict) -> list:
        tests, edge, ends, more = made
        lists = head["a"], head["b"]
        hits = np.concatenate([np.zeros(0, np.int64), *[low + np.flatnonzero(_scores(*four) < limit) for low, four in tests.parts()]])
        if stable:
            hits = hits[np.unique(edge[hits], return_index=True)[1]]  # tests of an edge stand in order
        else:
            most = max(int(np.max(end.flatten().to_numpy(), initial=0)) for end in lists)
            hits = _in_turn(tests, ends, hits, lists, most + 1)
        offsets = pa.array(np.searchsorted(hits, tests.first), pa.int32())
        sets = pa.ListArray.from_arrays(pa.array(np.arange(len(hits) + 1) * level, pa.int32()), pa.array(tests.given[hits].ravel(), pa.int32()))
        found = [pa.ListArray.from_arrays(offsets, c) for c in (pa.array(tests.a[hits], pa.int32()), pa.array(tests.b[hits], pa.int32()), sets)]
        first = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        more = np.zeros(first[-1], np.int64) if more is None else more
        more[edge[hits]] = 0
        left = np.flatnonzero(more)
        at = np.searchsorted(left, first)
        own = left - np.repeat(first[:-1], np.diff(at))
        total = np.concatenate(([0], np.cumsum(more)))[first]
        return [*found, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32())), pa.array(np.diff(total))]

    return begin, finish


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def single_separators(shared: SharedCounts, a: np.ndarray, b: np.ndarray, limit: float, stable: bool = True) -> np.ndarray:
    """For each edge of a cell, by a and b, the first gene given which its ends are independent, or -1: of the neighbours of a in
    order, then those of b.  If not ``stable``, edges that are separated leave the pools of the ones after them.
    """
    genes, given = shared.genes, np.full(len(a), -1, np.int64)
    near = np.zeros((genes, genes), bool)
    near[a, b] = near[b, a] = True
    size = len(a) if stable else IN_TURN
    for low in range(0, len(a), max(size, 1)):
        s, d = a[low : low + size], b[low : low + size]
        pools = np.concatenate((near[s], near[d]), axis=1)
        each = np.arange(len(s))
        pools[each, d] = pools[each, genes + s] = False
        edge, column = np.nonzero(pools)
        first = np.searchsorted(edge, np.arange(len(s) + 1))

        def hits(open_edges: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Place of the first separating candidate of some edges from given places on, or -1."""
            found, left = np.full(len(open_edges), -1), np.arange(len(open_edges))
            for many in chain(TRIED, repeat(len(column))):
                start = at[left]
                sizes = np.minimum(start + many, first[open_edges[left] + 1]) - start
                left, start, sizes = left[sizes > 0], start[sizes > 0], sizes[sizes > 0]
                if not len(left):
                    return found
                place, owner = _ranges(start, sizes), np.repeat(left, sizes)
                x, y, z = s[edge[place]], d[edge[place]], column[place] % genes
                good = np.flatnonzero(_scores(shared.single[z], shared.of(x, z), shared.of(y, z), shared.of(x, y, z)) < limit)
                owner, one = np.unique(owner[good], return_index=True)
                found[owner] = place[good[one]]
                at[left] = start + sizes
                left = left[found[left] < 0]

        found = hits(each, first[:-1].copy())
        if stable:
            given[found >= 0] = column[found[found >= 0]] % genes
            continue
        for e, place in enumerate(found):
            while place >= 0 and not near[s[e] if column[place] < genes else d[e], column[place] % genes]:
                place = hits(np.array([e]), np.array([place + 1]))[0]
            if place >= 0:
                given[low + e] = column[place] % genes
                near[s[e], d[e]] = near[d[e], s[e]] = False
    return given


def single_skeletons(vectors: DataFrame, alpha: float = 0.01, stable: bool = True) -> DataFrame:
    """(module, cell_id, a, b, sep_a, sep_b, given), a row per cell with an edge of level 0: the arrays a and b of the edges left after
    the tests given one gene, those separated, and the first gene that separates them."""
    limit = critical_z(alpha)

    def visit(bits: np.ndarray, n: int, values: tuple) -> tuple:
        a, b, _ = near_of(values[0], len(bits))
        given = single_separators(SharedCounts(bits), a, b, limit, stable)
        left, gone = given < 0, given >= 0
        return a[left], b[left], a[gone], b[gone], given[gone]

    names = ("a", "b", "sep_a", "sep_b", "given")
    masks = marginal_masks(vectors, alpha).select(*CELL, "masks")
    return written(over_cells(vectors, visit, "; ".join(f"{c} array<int>" for c in names), masks))


def single_outcomes(vectors: DataFrame, alpha: float = 0.01) -> DataFrame:
    """All tests given one gene: (module, cell_id, a, b, given, pool) with counts and verdict; ``pool`` tells whose neighbour the gene is."""
    def visit(bits: np.ndarray, n: int, values: tuple) -> tuple:
        genes = len(bits)
        a, b, near = near_of(values[0], genes)
        pools = np.concatenate((near[a], near[b]), axis=1)
        each = np.arange(len(a))
        pools[each, b] = pools[each, genes + a] = False
        edge, column = np.nonzero(pools)
        shared, x, y, z = SharedCounts(bits), a[edge], b[edge], column % genes
        return x, y, z, column // genes, shared.single[z], shared.of(x, z), shared.of(y, z), shared.of(x, y, z)

    schema = "a int; b int; given int; pool int; c_z bigint; c_xz bigint; c_yz bigint; c_xyz bigint"
    counted = over_cells(vectors, visit, schema, marginal_masks(vectors, alpha).select(*CELL, "masks"), flat=True)
    return counted.withColumn("separates", independent(F.col("c_z"), F.col("c_xz"), F.col("c_yz"), F.col("c_xyz"), alpha))


def linked_skeletons(expr: DataFrame, fraction: float = 0.1, alpha: float = 0.01, stable: bool = True) -> DataFrame:
    """``single_skeletons`` of an expression table."""
    return single_skeletons(written(cell_vectors(cell_neighborhoods(expr, fraction))), alpha, stable)


def linked_rows(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and separating sets of one row a cell, as rows."""
    if "sizes" in cells.columns:
        stop = F.aggregate("sizes", F.array(F.lit(0)), lambda upto, size: F.concat(upto, F.array(F.element_at(upto, -1) + size)))
        cells = cells.withColumn("_first", stop)
        sets = F.transform("sizes", lambda size, i: F.slice("given", F.get("_first", i) + 1, size))
    else:
        sets = F.transform("given", lambda z: F.array(z))
    separated = F.arrays_zip(F.col("sep_a").alias("a"), F.col("sep_b").alias("b"), sets.alias("sepset"))
    return cells.select(*CELL, F.inline(F.arrays_zip("a", "b"))), cells.select(*CELL, F.inline(separated))


def skeleton_levels(expr: DataFrame, levels: int = 1, fraction: float = 0.1, alpha: float = 0.01, stable: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges and separating sets after testing conditioning sets of up to ``levels`` genes, or of fewer if no edge has as many neighbours."""
    vectors = written(cell_vectors(cell_neighborhoods(expr, fraction)))
    if levels < 1:
        return written(marginal_edges_of(vectors, alpha)), None
    edges, found = linked_rows(single_skeletons(vectors, alpha, stable))
    for level in range(2, levels + 1):
        if not _tests_per_cell(edges, level).agg(F.max("load")).first()[0]:
            break
        separated = written(separated_edges(vectors, edges, level, alpha, stable))
        edges = written(edges.join(separated, list(EDGE), "left_anti"))
        found = found.unionByName(separated)
    return edges, found


def linked_full_skeletons(expr: DataFrame, deepest: int = 20, fraction: float = 0.1, alpha: float = 0.01, stable: bool = True) -> DataFrame:
    """(module, cell_id, a, b, sep_a, sep_b, sizes, given) after tests of all levels, a row per cell with an edge of level 0.

    ``sizes`` tells how many of ``given`` separate each of the pairs sep_a, sep_b.  A cell's single genes are tried as in
    ``single_skeletons``; if some gene still has three neighbours, larger sets follow by the walk over the same packed bits.
    """
    vectors = written(cell_vectors(cell_neighborhoods(expr, fraction)))
    base = critical_z(alpha)

    def visit(bits: np.ndarray, n: int, values: tuple) -> tuple:
        a, b, _ = near_of(values[0], len(bits))
        given = single_separators(SharedCounts(bits), a, b, base, stable)
        gone = given >= 0
        sets = [(int(x), int(y), [int(z)]) for x, y, z in zip(a[gone], b[gone], given[gone])]
        left = list(zip(a[~gone].tolist(), b[~gone].tolist()))
        if np.bincount(np.array(left, np.int64).ravel()).max(initial=0) > 2:
            left, larger = walk_levels(bits, n, lambda a, b, size: base, set(), set(), {}, deepest, stable, set(left), 2)
            sets += larger
        ends = lambda pairs: np.array(pairs, np.int64).reshape(-1, 2).T
        return *ends(left), *ends([s[:2] for s in sets]), np.array([len(s[2]) for s in sets], np.int64), np.array([z for s in sets for z in s[2]], np.int64)

    names = ("a", "b", "sep_a", "sep_b", "sizes", "given")
    masks = marginal_masks(vectors, alpha).select(*CELL, "masks")
    return written(over_cells(vectors, visit, "; ".join(f"{c} array<int>" for c in names), masks))


def full_skeletons(expr: DataFrame, deepest: int = 20, fraction: float = 0.1, alpha: float = 0.01, stable: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges and separating sets of all levels as rows."""
    return linked_rows(linked_full_skeletons(expr, deepest, fraction, alpha, stable))


def _scores(z: np.ndarray, x: np.ndarray, y: np.ndarray, xy: np.ndarray) -> np.ndarray:
    z, x, y, xy = (np.asarray(c, dtype=float) for c in (z, x, y, xy))
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = (z * xy - x * y) / (z * z)
        sigma = np.sqrt(np.maximum(x * y * (z - x) * (z - y), EPSILON) / (z * z * z * z * (z - 1.0) + EPSILON))
        score = np.abs(np.where(sigma > EPSILON, rho / sigma, np.where(np.abs(rho) > EPSILON, np.inf, 0.0)))
    return np.where(z <= 1, np.inf, score)


def _tally(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def first_separator(bits, a: int, b: int, pools, size: int, limit: float, batch: int = 64) -> tuple | None:
    """First subset of the pools, in order, given which a and b score under ``limit``; tested a batch at a time."""
    for pool in pools:
        subsets = combinations(pool, size)
        while chosen := list(islice(subsets, batch)):
            base = np.bitwise_and.reduce(bits[np.array(chosen)], axis=1)
            with_a = base & bits[a]
            score = _scores(_tally(base), _tally(with_a), _tally(base & bits[b]), _tally(with_a & bits[b]))
            hits = np.flatnonzero(score < limit)
            if hits.size:
                return chosen[hits[0]]
    return None


def walk_levels(bits: np.ndarray, n: int, limits, banned: set, required: set, tiers: dict, deepest: int, stable: bool,
                left: set | None = None, smallest: int = 0) -> tuple[list, list]:
    """Edges and separating sets of one cell; ``limits(a, b, size)`` is the critical score of a test.

    ``left`` are the edges that sets under ``smallest`` genes left, if those have been tested before.
    """
    genes = len(bits)
    open_pair = lambda pair: pair not in banned and (left is None or pair in left)
    near = [{h for h in range(genes) if h != g and open_pair((min(g, h), max(g, h)))} for g in range(genes)]
    sepsets = []
    single = _tally(bits)
    for size in range(smallest, deepest + 1):
        if all(len(s) < size for s in near):
            break
        start = [sorted(s) for s in near]
        edges = [(a, b) for a in range(genes) for b in start[a] if b > a]
        dropped = []
        if size == 0:
            both = np.stack([_tally(row & bits) for row in bits])
            marginal = _scores(n, single[:, None], single[None, :], both)
        for a, b in edges:
            if (a, b) in required:
                continue
            limit = limits(a, b, size)
            if size == 0:
                hit = () if marginal[a, b] < limit else None
            else:
                now = start if stable else {a: sorted(near[a]), b: sorted(near[b])}
                pools = [[g for g in now[end] if g != other] for end, other in ((a, b), (b, a))]
                if tiers:
                    top = min(tiers[a], tiers[b])
                    pools = [[g for g in pool if tiers[g] <= top] for pool in pools]
                hit = first_separator(bits, a, b, pools, size, limit)
            if hit is None:
                continue
            sepsets.append((a, b, [int(g) for g in hit]))
            if stable:
                dropped.append((a, b))
            else:
                near[a].discard(b)
                near[b].discard(a)
        for a, b in dropped:
            near[a].discard(b)
            near[b].discard(a)
    return [(a, b) for a in range(genes) for b in sorted(near[a]) if b > a], sepsets


def _pair_lists(df: DataFrame, name: str) -> DataFrame:
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return df.groupBy("module").agg(F.collect_set(pair).alias(name))


def skeletons(
    vectors: DataFrame,
    alpha: float = 0.01,
    deepest: int = 20,
    stable: bool = True,
    forbidden: DataFrame | None = None,
    required: DataFrame | None = None,
    tiers: DataFrame | None = None,
    levels: DataFrame | None = None,
    second: DataFrame | None = None,
    key_block: int = KEY_BLOCK,
) -> DataFrame:
    """Full skeleton per cell: ``edges`` and ``sepsets`` arrays.

    ``forbidden`` and ``required`` hold (module, a, b); ``tiers`` (module, gene, tier).  ``levels`` holds raised
    significance (module, a, b, alpha, cap), with cell_id if it differs by cell, used while the conditioning
    set has at most ``cap`` genes (-1 for always).  ``second`` (module, second) lists, in order, the genes whose
    second-modality bits follow the first-modality ones in joint vectors.
    """
    shared = vectors.select("module").distinct()
    if forbidden is not None:
        shared = shared.join(_pair_lists(forbidden, "forbidden"), "module", "left")
    if required is not None:
        shared = shared.join(_pair_lists(required, "required"), "module", "left")
    if tiers is not None:
        ordered = tiers.groupBy("module").agg(F.collect_list(F.struct("gene", "tier")).alias("tiers"))
        shared = shared.join(ordered, "module", "left")
    if second is not None:
        shared = shared.join(second, "module", "left")
    extra = None
    if levels is not None:
        entry = F.collect_list(F.struct("a", "b", "alpha", "cap")).alias("levels")
        if "cell_id" in levels.columns:
            extra = vectors.select(*CELL).join(levels.groupBy(*CELL).agg(entry), list(CELL), "left")
        else:
            shared = shared.join(levels.groupBy("module").agg(entry), "module", "left")
    names = (["levels"] if extra is not None else []) + [c for c in shared.columns if c != "module"]

    def visit(bits: np.ndarray, n: int, values: tuple) -> tuple:
        given = {k: (v if v is not None else ()) for k, v in zip(names, values)}
        if "second" in given:
            split = len(bits) - len(given["second"])
            both = bits[:split].copy()
            both[list(given["second"])] &= bits[split:]
            bits = both
        pairs = lambda name: {(r["a"], r["b"]) for r in given.get(name, ())}
        base = critical_z(alpha)
        raised: dict = {}
        for r in given.get("levels", ()):
            raised.setdefault((r["a"], r["b"]), []).append((critical_z(r["alpha"]), r["cap"]))

        def limits(a: int, b: int, size: int) -> float:
            return min([base, *(z for z, cap in raised.get((a, b), ()) if cap < 0 or size <= cap)])

        tier_of = {r["gene"]: r["tier"] for r in given.get("tiers", ())}
        return walk_levels(bits, n, limits, pairs("forbidden"), pairs("required"), tier_of, deepest, stable)

    schema = "edges array<struct<a:int,b:int>>; sepsets array<struct<a:int,b:int,zs:array<int>>>"
    return over_bits(vectors, visit, schema, extra, shared, key_block)


def skeleton_edges(found: DataFrame) -> DataFrame:
    return found.select(*CELL, F.inline("edges"))


def skeleton_sepsets(found: DataFrame) -> DataFrame:
    return found.select(*CELL, F.inline("sepsets")).withColumnRenamed("zs", "sepset")
