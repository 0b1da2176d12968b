"""Conditional neighbourhood counts: how many cells lie in k's neighbourhood for every gene of a set.

Four physical strategies give the same numbers.

``ranged``  for gene pairs: a task takes the pairs of two tiles of genes and counts, for each key, the points in a
            rectangle of ranks, with prefix counts over blocks of one order.  The work is n log n in practice, and
            all that it holds is cut into key and member passes of fixed size.

``bitmap``  key cells are cut into blocks, member cells into blocks, and each task streams the member blocks
            past one key block.  Counts are sums over members, so a task packs one member block at a time, adds
            its counts to those of its keys and drops the bits; what it holds does not depend on the number of
            cells.  No (key, member) pair is ever a row.  The work is n^2 / 64 words per gene set.
``held``    cells are dealt to a fixed number of tasks, each of which is sent all members once and packs the bits of a few
            cells after another.  What is shuffled does not depend on the number of gene sets, and a cell's steps may
            choose what to count by what they have counted.
``dyadic``  for gene pairs: count points under a corner with prefix sums over power-of-two rank intervals,
            O(log n) rows per distinct point and query.  Purely relational and near linear, for modules too
            large for any all-against-all pass and for heavily tied data.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .neighborhoods import KEYS, cell_neighborhoods, tie_neighborhoods
from .ranks import running_total
from .sparse import sparse_neighborhoods

MEMBER_BLOCK = 4096
KEY_BLOCK = 128
PREFIX_BLOCK = 2048  # members whose prefix bits stand beside each other
COUNT_BLOCK = 2**14  # key cells whose running counts one task holds
HELD_TESTS = 2**21  # tests whose four running counts one task holds
LISTED_TESTS = 2**17  # of these, as many as are written out in full at a time
BLOCK_BITS = 2**30  # packed bits one task may hold: 128 MB
GENE_TILE = 8  # genes on either side of the pairs that a task counts
KEY_CELLS, MEMBER_CELLS = 2**19, 2**20  # keys of a task, members it counts at a time
HELD_SETS, TURN_CELLS = 2**24, 2**18  # gene sets whose counts one task holds, members it sorts at a time
TASKS = 4  # tasks a core that are each sent all members
HELD_STARTS = 2**26  # tie starts of members that a task keeps in memory; further ones wait in a file of its own
COMPARED, PACKED_WORDS = 2**15, 2**22  # members compared at a time; words of the cells packed together: 32 MB
HELD_ROWS = 2**19  # entries a task gathers before it hands them on
ROOM = 2**15  # words of gene sets that are met at a time
KNOWN_SETS = 2**22  # sets a table of all of them may have
SIDE = 64  # bits of a word: blocks of SIDE words answer range counts
CELL = ("module", "cell_id")


def cell_vectors(neighborhoods: DataFrame, *more: str) -> DataFrame:
    """One row per cell with gene-ordered arrays: own tie starts, the range of tie starts per gene, and further integer columns."""
    entry = F.struct("gene", "tie_start", "lo_start", "hi_start", *more)
    ordered = F.array_sort(F.collect_list(entry))
    part = lambda name: F.transform(F.col("_g"), lambda e: e[name].cast("int"))
    return (
        neighborhoods.groupBy(*CELL)
        .agg(ordered.alias("_g"), F.max("n").alias("n"))
        .select(*CELL, "n", part("tie_start").alias("own"), part("lo_start").alias("lo"), part("hi_start").alias("hi"), *[part(c).alias(c) for c in more])
    )


def _pack(members: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits (keys, genes, words) telling which members fall in each key's range."""
    keys, genes = lo.shape
    words = -(-len(members) // 64)
    bits = np.zeros((keys, genes, words * 8), dtype=np.uint8)
    used = -(-len(members) // 8)
    for g in range(genes):
        column = members[:, g][None, :]
        bits[:, g, :used] = np.packbits((column >= lo[:, g, None]) & (column <= hi[:, g, None]), axis=1)
    return bits.view(np.uint64)


def _prefix_words(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per gene the sorted tie starts of a member block, and for each place the bits of the members before it."""
    count, genes = members.shape
    order = members.argsort(axis=0, kind="stable").T
    words = np.zeros((genes, count + 1, -(-count // 64)), np.uint64)
    words[np.arange(genes)[:, None], np.arange(1, count + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
    return np.take_along_axis(members.T, order, axis=1), np.bitwise_or.accumulate(words, axis=1, out=words)


def _streamed(vectors: DataFrame, per_block: Column, member_block: int, extra: DataFrame | None, shared: DataFrame | None) -> tuple[DataFrame, list[str], list[str]]:
    """Every member block next to each key block of its module, and the names of the further columns."""
    vectors = vectors.withColumn("_per_block", per_block.cast("bigint"))
    blocks = lambda size: F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n") / size))
    fields = [] if extra is None else [c for c in extra.columns if c not in CELL]
    common = [] if shared is None else [c for c in shared.columns if c != "module"]
    keyed = vectors if extra is None else vectors.join(extra, list(CELL))
    keys = keyed.groupBy("module", blocks(F.col("_per_block")).alias("_kb")).agg(
        F.first("n").alias("n"), F.collect_list(F.struct("cell_id", "lo", "hi", *fields)).alias("_k")
    ).select(
        "module", "_kb", "n",
        F.col("_k.cell_id").alias("cells"), F.flatten("_k.lo").alias("lo"), F.flatten("_k.hi").alias("hi"),
        *[F.col(f"_k.{f}").alias(f) for f in fields],
    )
    if shared is not None:
        keys = keys.join(shared, "module", "left")
    # Every member block goes to each key block of its module, so even one huge module spreads over all tasks.
    members = (
        vectors.groupBy("module", blocks(F.lit(member_block)).alias("_mb"))
        .agg(F.first("n").alias("n"), F.first("_per_block").alias("_per_block"), F.flatten(F.collect_list("own")).alias("own"))
        .select("module", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("_per_block")) - 1)).alias("_kb"), "own")
    )
    return keys.join(members.hint("merge"), ["module", "_kb"]), fields, common


def _flat(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def _answers(schema: str) -> tuple[str, pa.Schema]:
    full = "module string, cell_id bigint, " + ", ".join(c.strip() for c in schema.split(";"))
    return full, to_arrow_schema(T.StructType.fromDDL(full))


def over_bits(
    vectors: DataFrame,
    visit: Callable[[np.ndarray, int, tuple], tuple],
    schema: str,
    extra: DataFrame | None = None,
    shared: DataFrame | None = None,
    key_block: int = KEY_BLOCK,
    member_block: int = MEMBER_BLOCK,
) -> DataFrame:
    """Call ``visit(bits, n, extra_values)`` once per key cell; ``bits`` is (genes, words) of packed members.

    For steps that choose what to count as they go and so need all bits of a cell; sums go through ``over_counts``.
    ``extra`` holds further columns per (module, cell); only cells present in it are visited.  ``shared`` holds
    columns per module, sent once per block and handed over after the cell's own.
    """
    # Wide or long modules get smaller key blocks, so what a task holds does not grow with the data.
    fits = F.floor(F.lit(BLOCK_BITS) / (F.col("n") * F.size("own")))
    paired, fields, common = _streamed(vectors, F.least(F.lit(key_block), F.greatest(F.lit(1), fits)), member_block, extra, shared)
    full, arrow = _answers(schema)

    def task(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, head = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                if head is None:
                    head = {c: batch.column(c)[row].as_py() for c in ("cells", "n", *fields, *common)}
                    shape = (len(head["cells"]), -1)
                    lo, hi = (_flat(batch, side, row).reshape(shape) for side in ("lo", "hi"))
                parts.append(_pack(_flat(batch, "own", row).reshape(-1, lo.shape[1]), lo, hi))
        bits = np.concatenate(parts, axis=2)
        same = tuple(head[f] for f in common)
        answers = [visit(bits[i], head["n"], (*(head[f][i] for f in fields), *same)) for i in range(len(bits))]
        values = [[group[0].as_py()] * len(bits), head["cells"], *map(list, zip(*answers))]
        arrays = [pa.array(v, type=f.type) for v, f in zip(values, arrow)]
        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return paired.groupBy("module", "_kb").applyInArrow(task, full)


def over_counts(
    vectors: DataFrame,
    begin: Callable[[dict, int], object],
    add: Callable[[object, slice, np.ndarray], None],
    finish: Callable[[object, dict], list],
    schema: str,
    extra: DataFrame | None = None,
    key_block: int | None = None,
    member_block: int = MEMBER_BLOCK,
    load: DataFrame | None = None,
) -> DataFrame:
    """Sums over members for every key cell: ``begin(head, genes)`` makes the running sums of a key block,
    ``add(sums, keys, bits)`` adds one packed member block for a slice of the keys, ``finish`` gives the columns.

    ``head`` holds the block's cells, n and, as Arrow arrays with an entry per cell, the columns of ``extra``; only cells
    present in it are kept.  ``load`` (module, tests) tells how many tests all of them have: blocks shrink with it.  A block's keys come
    first and once; then member blocks stream by, whose range bits are differences of prefix bits.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    cut = F.lit(key_block) if key_block else F.least(F.lit(COUNT_BLOCK), F.greatest(F.lit(KEY_BLOCK), F.ceil(F.col("n") / (2 * cores))))  # small modules use all cores
    parts = F.ceil(F.col("n") / cut)
    if load is not None:
        # Cells are dealt by hash, so a block has its share of the tests, whatever single cells have.
        vectors = vectors.join(load.select("module", F.col("tests").alias("_tests")), "module")
        parts = F.least(F.col("n"), F.greatest(parts, F.ceil(F.col("_tests") / F.lit(HELD_TESTS))))
    vectors = vectors.withColumn("_parts", parts.cast("bigint"))
    block = lambda number: F.pmod(F.xxhash64("cell_id"), number)
    fields = [] if extra is None else [c for c in extra.columns if c not in CELL]
    keyed = vectors if extra is None else vectors.join(extra, list(CELL))
    keys = keyed.groupBy("module", block(F.col("_parts")).alias("_kb")).agg(
        F.first("n").alias("n"), F.collect_list(F.struct("cell_id", "lo", "hi", *fields)).alias("_k")
    ).select("module", "_kb", "n", F.col("_k.cell_id").alias("cells"), F.flatten("_k.lo").alias("lo"), F.flatten("_k.hi").alias("hi"),
             *[F.col(f"_k.{f}").alias(f) for f in fields])
    members = vectors.groupBy("module", block(F.ceil(F.col("n") / member_block)).alias("_mb")).agg(
        F.first("_parts").alias("_parts"), F.flatten(F.collect_list("own")).alias("own")
    ).select("module", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_kb"), "own")
    paired = keys.unionByName(members, allowMissingColumns=True).repartition(8 * cores, "module", "_kb")
    full, arrow = _answers(schema)

    def task(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sums = None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("cells")[row].is_valid:
                    head = {c: batch.column(c)[row].as_py() for c in ("cells", "n")} | {c: batch.column(c)[row].values for c in fields}
                    lo, hi = (_flat(batch, side, row).reshape(len(head["cells"]), -1) for side in ("lo", "hi"))
                    sums = begin(head, lo.shape[1])
                    continue
                if head is None:  # no key of this block has anything to count
                    return
                own = _flat(batch, "own", row).reshape(-1, lo.shape[1])
                for low in range(0, len(own), PREFIX_BLOCK):
                    values, words = _prefix_words(own[low : low + PREFIX_BLOCK])
                    first, stop = np.empty(lo.shape, np.int32), np.empty(lo.shape, np.int32)
                    for g, column in enumerate(values):
                        first[:, g] = np.searchsorted(column, lo[:, g], "left")
                        stop[:, g] = np.maximum(first[:, g], np.searchsorted(column, hi[:, g], "right"))
                    genes = np.arange(lo.shape[1])
                    for at in range(0, len(lo), KEY_BLOCK):
                        keys = slice(at, min(at + KEY_BLOCK, len(lo)))
                        add(sums, keys, words[genes, stop[keys]] ^ words[genes, first[keys]])
        if head is None:
            return
        values = [[group[0].as_py()] * len(lo), head["cells"], *finish(sums, head)]
        yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    return paired.sortWithinPartitions("module", "_kb", F.col("cells").isNull()).groupBy("module", "_kb").applyInArrow(task, full)


def _tally(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def pair_sums(head: dict, genes: int) -> tuple[np.ndarray, np.ndarray]:
    keys = len(head["cells"])
    return np.zeros((keys, genes), np.int64), np.zeros((keys, genes * (genes - 1) // 2), np.int32)


def add_pairs(sums: tuple, keys: slice, bits: np.ndarray) -> None:
    single, both = sums
    single[keys] += _tally(bits)
    at, genes = 0, bits.shape[1]
    for g in range(genes - 1):
        both[keys, at : at + genes - g - 1] += _tally(bits[:, g, None] & bits[:, g + 1 :]).astype(np.int32)
        at += genes - g - 1


def pair_count_arrays(expr: DataFrame, fraction: float = 0.1, **blocks: int) -> DataFrame:
    """Per cell: ``single`` counts in gene order and ``both`` counts in (a, b) order, a < b."""
    vectors = cell_vectors(cell_neighborhoods(expr, fraction))
    return over_counts(vectors, pair_sums, add_pairs, lambda sums, _: [list(x) for x in sums], "single array<bigint>; both array<bigint>", **blocks)


def all_pairs(genes: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(genes) for b in range(a + 1, genes)]


def _units(pairs: list[tuple[int, int]]) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Pairs by the tiles of their genes, each list with the genes it needs."""
    units: dict = {}
    for a, b in pairs:
        units.setdefault((a // GENE_TILE, b // GENE_TILE), []).append((a, b))
    return [(unit, sorted({g for pair in unit for g in pair})) for unit in units.values()]


def _points_between(seq: np.ndarray, corner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of the ascending ``corner``: how many of ``seq[:corner]``, a permutation of 0..m-1, lie in low..high-1.

    Blocks of 4,096 places pass by.  Bits of the values seen so far, before and after a block, tell how many smaller values stand
    before it and in it.  Inside, places and ranks of values are cut into words of 64: bits of each word of ranks and each word of
    places tell the rest.  A corner costs a few lookups whatever m is, and a block m / 64 words.
    """
    m, size = len(seq), SIDE * SIDE
    blocks = m // size + 1
    padded = np.arange(blocks * size)
    padded[:m] = seq
    place = np.empty_like(padded)
    place[padded] = np.arange(len(padded))
    of = (place // size).astype(np.uint16 if blocks < 2**16 else np.int32)
    order = place[np.argsort(of, kind="stable")].reshape(blocks, size)  # places by block, then value
    one = np.uint64(1) << np.arange(SIDE, dtype=np.uint64)
    under = one - np.uint64(1)
    masks = np.zeros((blocks * SIDE, SIDE + 1), np.uint64)  # by word of places and number of its least values
    np.cumsum(one[padded.reshape(-1, SIDE).argsort(axis=1)], axis=1, out=masks[:, 1:])
    ranked = np.zeros((blocks, SIDE + 1, SIDE + 1), np.uint64)  # by word of ranks: those in words of places before
    at = (np.arange(blocks)[:, None] * (SIDE + 1) + np.arange(size) // SIDE) * (SIDE + 1) + order % size // SIDE + 1
    np.add.at(ranked.reshape(-1), at.ravel(), np.tile(one, blocks * SIDE))
    np.cumsum(ranked, axis=2, out=ranked)
    full = np.zeros(ranked.shape, np.int16)  # the same for all words of ranks before
    np.cumsum(np.bitwise_count(ranked[:, :-1]), axis=1, dtype=np.int16, out=full[:, 1:])
    masks, ranked, full = (t.reshape(blocks, -1) for t in (masks, ranked, full))
    cuts = np.searchsorted(corner, np.arange(blocks + 1) * size)
    seen, upto, found = np.zeros(blocks * SIDE, np.uint64), np.zeros(blocks * SIDE, np.int64), np.empty(len(corner), np.int32)
    for x in range(blocks):
        values = padded[x * size : (x + 1) * size]
        seen_then = seen.copy()
        np.add.at(seen_then, values // SIDE, one[values % SIDE])
        upto_then = np.zeros_like(upto)
        np.cumsum(np.bitwise_count(seen_then[:-1]), out=upto_then[1:])
        part = slice(cuts[x], cuts[x + 1])
        if part.start < part.stop:
            place_in = corner[part] - x * size
            word, bits = place_in // SIDE, under[place_in % SIDE]

            def smaller(t: np.ndarray) -> np.ndarray:
                own, less = t // SIDE, under[t % SIDE]
                before = upto[own] + np.bitwise_count(seen[own] & less)
                inside = upto_then[own] + np.bitwise_count(seen_then[own] & less) - before
                cell, less = inside // SIDE * (SIDE + 1) + word, under[inside % SIDE]
                whole = full[x][cell] + np.bitwise_count(ranked[x][cell] & less)
                more = full[x][cell + 1] + np.bitwise_count(ranked[x][cell + 1] & less) - whole
                return before + whole + np.bitwise_count(masks[x][word * (SIDE + 1) + more] & bits)

            found[part] = smaller(high[part]) - smaller(low[part])
        seen, upto = seen_then, upto_then
    return found


def _rectangle_counts(keys: np.ndarray, members: np.ndarray, genes: list[int], pairs: list[tuple[int, int]]) -> Iterator[tuple]:
    """(c_a, c_b, c_ab) of every key for each pair; ``keys`` (genes, 2, keys) are ranges, ``members`` (genes, members) tie starts."""
    facts = {}
    for g, (lo, hi), own in zip(genes, keys, members):
        order = np.argsort(own, kind="stable").astype(np.int32)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order), dtype=np.int32)
        first = np.searchsorted(own[order], lo, "left").astype(np.int32)
        facts[g] = order, rank, first, np.maximum(first, np.searchsorted(own[order], hi, "right").astype(np.int32))
    last = None
    for a, b in pairs:
        order, _, first_a, stop_a = facts[a]
        _, rank, first_b, stop_b = facts[b]
        if a != last:
            corners = np.concatenate((first_a, stop_a))
            turn = np.argsort(corners, kind="stable")
            corners, key, last = corners[turn], turn % max(len(first_a), 1), a
        counted = np.empty(len(corners), np.int32)
        counted[turn] = _points_between(rank[order], corners, first_b[key], stop_b[key])
        yield stop_a - first_a, stop_b - first_b, counted[len(first_a):] - counted[: len(first_a)]


def over_pairs(
    vectors: DataFrame,
    keep: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
    pairs: Callable[[int], list[tuple[int, int]]] = all_pairs,
    key_cells: int | None = None,
    member_cells: int | None = None,
    masks: bool = False,
) -> DataFrame:
    """(module, cell_id, a, b, c_a, c_b, c_ab) of the gene pairs that ``pairs`` lists for a number of genes.

    Every task has the genes of two tiles for one part of the keys.  It counts at most ``member_cells`` members at a time, so
    what it holds does not grow with the cells.  ``keep(n, c_a, c_b, c_ab)`` chooses the rows that leave the task.  With ``masks``
    a task gives (module, cell_id, genes, unit, mask) instead: one row per cell, with a bit for each pair of its tiles.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    key_cells, member_cells = key_cells or KEY_CELLS, member_cells or MEMBER_CELLS
    least = min(MEMBER_BLOCK, key_cells, member_cells)
    block = F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n") / F.lit(least)))
    packed = vectors.groupBy("module", block.alias("_block")).agg(F.first("n").alias("n"), F.collect_list(F.struct("cell_id", "own", "lo", "hi")).alias("_v")).select(
        "module", "_block", "n", F.col("_v.cell_id").alias("cells"), *[F.flatten(f"_v.{c}").alias(c) for c in ("own", "lo", "hi")])
    dealt = "module string, _unit int, _kb int, n bigint, genes int, cells array<bigint>, side array<int>"
    dealt_arrow = to_arrow_schema(T.StructType.fromDDL(dealt))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                module, block, n = (batch.column(c)[row].as_py() for c in ("module", "_block", "n"))
                cells = _flat(batch, "cells", row)
                own, lo, hi = (_flat(batch, c, row).reshape(len(cells), -1).T for c in ("own", "lo", "hi"))
                ranges = np.stack((lo, hi), axis=1)
                units = _units(pairs(len(own)))
                parts = max(-(-n // key_cells), min(-(-2 * cores // max(len(units), 1)), -(-n // (2 * MEMBER_BLOCK))))
                for u, (_, genes) in enumerate(units):
                    same = lambda kb, ids, side: (module, u, kb, n, len(own), ids, side)
                    rows = [same(block % parts, cells, ranges[genes].ravel())] + [same(kb, None, own[genes].ravel()) for kb in range(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), dealt_arrow)], schema=dealt_arrow)

    answer = "module string, cell_id bigint, genes int, unit int, mask bigint" if masks else "module string, cell_id bigint, a int, b int, c_a bigint, c_b bigint, c_ab bigint"
    answer_arrow = to_arrow_schema(T.StructType.fromDDL(answer))

    def task(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, held, waiting, ids, ranges, keys, sums = group[0].as_py(), [], 0, [], [], None, None

        def counted() -> Iterator[tuple]:
            return _rectangle_counts(keys, np.concatenate(held, axis=1), genes, unit)

        for batch in batches:
            for row in range(batch.num_rows):
                if not ids and not held:
                    n = batch.column("n")[row].as_py()
                    all_genes = batch.column("genes")[row].as_py()
                    unit, genes = _units(pairs(all_genes))[group[1].as_py()]
                side = _flat(batch, "side", row)
                if batch.column("cells")[row].is_valid:
                    if keys is not None:
                        raise RuntimeError("keys must come before members")
                    ids.append(_flat(batch, "cells", row))
                    ranges.append(side.reshape(len(genes), 2, -1))
                    continue
                side = side.reshape(len(genes), -1)
                if held and waiting + side.shape[1] > member_cells:
                    if keys is None:
                        keys = np.concatenate(ranges, axis=2) if ranges else np.zeros((len(genes), 2, 0), np.int32)
                    sums = [tuple(x + y for x, y in zip(more, old)) if old else more for more, old in zip(counted(), sums or [()] * len(unit))]
                    held, waiting = [], 0
                held.append(side)
                waiting += side.shape[1]
        if not ids:  # a block of the hash that no key fell into
            return
        keys = np.concatenate(ranges, axis=2) if keys is None else keys
        ids = np.concatenate(ids)
        bits = np.zeros(len(ids), np.uint64)
        for place, ((a, b), more, old) in enumerate(zip(unit, counted(), sums or [()] * len(unit))):
            totals = [x + y for x, y in zip(more, old)] if old else more
            if masks:
                bits |= np.asarray(keep(n, *totals)).astype(np.uint64) << np.uint64(place)
                continue
            at = np.arange(len(ids)) if keep is None else np.flatnonzero(keep(n, *totals))
            for low in range(0, len(at), 2**17):
                some = at[low : low + 2**17]
                same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(some))
                yield pa.RecordBatch.from_arrays(
                    [same(module, pa.string()), pa.array(ids[some]), same(a, pa.int32()), same(b, pa.int32()), *[pa.array(c[some].astype(np.int64)) for c in totals]], schema=answer_arrow)
        for low in range(0, len(ids) if masks else 0, 2**17):
            some = slice(low, low + 2**17)
            same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(ids[some]))
            yield pa.RecordBatch.from_arrays(
                [same(module, pa.string()), pa.array(ids[some]), same(all_genes, pa.int32()), same(group[1].as_py(), pa.int32()), pa.array(bits[some].view(np.int64))], schema=answer_arrow)

    spread = packed.mapInArrow(deal, dealt).repartition(8 * cores, "module", "_unit", "_kb")
    return spread.sortWithinPartitions("module", "_unit", "_kb", F.col("cells").isNull()).groupBy("module", "_unit", "_kb").applyInArrow(task, answer)


@lru_cache(maxsize=16)
def _mask_places(genes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit, a and b of all pairs of a number of genes, by a and b."""
    every = np.array([(u * 64 + place, a, b) for u, (unit, _) in enumerate(_units(all_pairs(genes))) for place, (a, b) in enumerate(unit)])
    return tuple(every[np.lexsort((every[:, 2], every[:, 1]))].T)


def mask_pairs(masks: np.ndarray, genes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, a and b of the pairs, in this order, whose bits are set in the masks (rows, units) of all pairs of a number of genes."""
    bit, a, b = _mask_places(genes)
    held = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")[:, bit]
    row, at = np.nonzero(held)
    return row, a[at], b[at]


def pair_counts(expr: DataFrame, fraction: float = 0.1, n_genes: int | None = None) -> DataFrame:
    """(module, cell, a, b, c_a, c_b, c_ab) for all gene pairs of cells with dense 0..G-1 gene ordinals."""
    return over_pairs(cell_vectors(cell_neighborhoods(expr, fraction)))


class _Subsets:
    """Lists of gene sets for the cells of a block, and the running counts of the members that all genes of a set share."""

    def __init__(self, lists: pa.ListArray, genes: int) -> None:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.lists = lists.flatten()
        # Every row of sets ends in the one that stands for all members.
        self.sets = _filled(self.lists, genes, 1)
        self.owner = np.repeat(np.arange(len(lists)), sizes)
        self.counts = np.zeros(len(self.lists), np.int64)

    def add(self, keys: slice, bits: np.ndarray) -> None:
        whole = np.full((len(bits), 1, bits.shape[2]), ~np.uint64(0))
        bits = np.concatenate((bits, whole), axis=1)
        low, high = self.first[keys.start], self.first[keys.stop]
        for at in range(low, high, 4096):
            part = slice(at, min(at + 4096, high))
            shared = bits[self.owner[part] - keys.start, self.sets[part, 0]]
            for column in self.sets[part, 1:].T:
                shared = shared & bits[self.owner[part] - keys.start, column]
            self.counts[part] += _tally(shared)


def _filled(lists: pa.ListArray, filler: int, more: int = 0) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, filled up at the end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.full((len(lists), int(sizes.max(initial=0)) + more), filler, np.int64)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat(np.arange(len(lists)), sizes), place] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


class Tests:
    """Tests of the cells of a block as flat arrays, and the running counts of the given genes alone, with a, with b, with both.

    ``given`` has one row per test, filled up with the number that stands for all members; ``sizes`` tests per cell.  Tests of a
    cell share most of their gene sets, so each set is counted once and its count handed to all tests that ask for it.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, given: np.ndarray, sizes: np.ndarray, genes: int) -> None:
        self.a, self.b, self.given = a, b, given
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.of, owners, sets, known = np.empty((4, len(a)), np.int32), [], [], 0
        # Sets are told apart for a few cells at a time, so that only the tests themselves are held for the whole block.
        cuts = np.unique(np.searchsorted(self.first, np.append(np.arange(0, len(a), LISTED_TESTS), len(a))))
        for cell, stop in zip(cuts, cuts[1:]):
            part = slice(self.first[cell], self.first[stop])
            set_owner, own, self.of[:, part] = self._distinct(a[part], b[part], given[part], self.owner[part] - cell, stop - cell, genes)
            self.of[:, part] += known
            known += len(own)
            owners.append((set_owner + cell).astype(np.int32))
            sets.append(own.astype(np.int32))
        self.set_owner = np.concatenate([np.zeros(0, np.int32), *owners])
        self.sets = np.concatenate([np.zeros((0, given.shape[1] + 2), np.int32), *sets])
        self.set_first = np.searchsorted(self.set_owner, np.arange(len(sizes) + 1))
        self.set_counts = np.zeros(known, np.int64)

    @staticmethod
    def _distinct(a: np.ndarray, b: np.ndarray, given: np.ndarray, owner: np.ndarray, cells: int, genes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and genes of the distinct sets of some tests, and the set of each of a test's four counts."""
        a, b, every = a[:, None], b[:, None], np.full((len(a), 1), genes)
        asked = [np.sort(np.hstack(ends + [given]), axis=1).astype(np.int64) for ends in ([every, every], [a, every], [b, every], [a, b])]
        width, owner = given.shape[1] + 2, owner.astype(np.int64)
        if int(cells) * (genes + 1) ** width < 2**63:
            place = (genes + 1) ** np.arange(width - 1, -1, -1, dtype=np.int64)
            codes = np.concatenate([rows @ place + owner * (genes + 1) ** width for rows in asked])
            kept, of = np.unique(codes, return_inverse=True)
            set_owner, left = np.divmod(kept, (genes + 1) ** width)
            sets = left[:, None] // place % (genes + 1)
        else:
            kept, of = np.unique(np.concatenate([np.column_stack((owner, rows)) for rows in asked]), axis=0, return_inverse=True)
            set_owner, sets = kept[:, 0], kept[:, 1:]
        return set_owner, sets, of.reshape(4, len(a))

    def add(self, keys: slice, bits: np.ndarray) -> None:
        whole = np.full((len(bits), 1, bits.shape[2]), ~np.uint64(0))
        bits = np.concatenate((bits, whole), axis=1)
        flat = bits.reshape(-1, bits.shape[2])
        low, high = self.set_first[keys.start], self.set_first[keys.stop]
        for at in range(low, high, 4096):
            part = slice(at, min(at + 4096, high))
            rows = (self.set_owner[part] - keys.start)[:, None] * bits.shape[1] + self.sets[part]
            shared = flat.take(rows[:, 0], axis=0)
            for column in rows[:, 1:].T:
                shared &= flat.take(column, axis=0)
            # A member block's bits are few enough for exact single precision sums, which are faster than integer ones.
            self.set_counts[part] += (np.bitwise_count(shared).astype(np.float32) @ np.ones(shared.shape[1], np.float32)).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return self.set_counts[self.of].T

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """The four counts of some tests after another, with the number of the first."""
        for low in range(0, len(self.a), LISTED_TESTS):
            yield low, self.set_counts[self.of[:, low : low + LISTED_TESTS]]


def _given_tests(head: dict, genes: int) -> Tests:
    flat = head["tests"].flatten()
    given = _filled(flat.field("zs"), genes)
    ends = (flat.field(end).to_numpy(zero_copy_only=False).astype(np.int64) for end in ("a", "b"))
    return Tests(*ends, given, head["tests"].value_lengths().to_numpy(zero_copy_only=False), genes)


def _tested(sums: Tests, head: dict) -> list:
    """The tests as they came, beside four counts each."""
    tests = head["tests"]
    flat = tests.flatten()
    counts = sums.counts.copy()
    counts[flat.field("zs").value_lengths().to_numpy(zero_copy_only=False) == 0, 0] = head["n"]
    offsets = pa.array(sums.first, pa.int32())
    found = pa.StructArray.from_arrays(
        [flat.field(c) for c in ("a", "b", "zs", "turn")] + [pa.array(c) for c in counts.T], ["a", "b", "zs", "turn", "c_z", "c_xz", "c_yz", "c_xyz"])
    return [pa.ListArray.from_arrays(offsets, found)]


def test_counts(vectors: DataFrame, tests: DataFrame) -> DataFrame:
    """Four counts per test (module, cell, a, b, zs, turn): z, xz, yz and xyz."""
    grouped = cut_lineage(tests.groupBy(*CELL).agg(F.collect_list(F.struct("a", "b", "zs", "turn")).alias("tests")))
    load = grouped.groupBy("module").agg(F.sum(F.size("tests")).alias("tests"))
    schema = (
        "found array<struct<a:int,b:int,zs:array<int>,turn:array<int>,c_z:bigint,c_xz:bigint,c_yz:bigint,c_xyz:bigint>>"
    )
    return over_counts(vectors, _given_tests, Tests.add, _tested, schema, grouped, load=load).select(*CELL, F.inline("found"))


def set_counts(vectors: DataFrame, sets: DataFrame) -> DataFrame:
    """Count for every (module, cell, genes) row; the empty set counts all cells."""
    grouped = cut_lineage(sets.distinct().groupBy(*CELL).agg(F.collect_list("genes").alias("sets")))
    load = grouped.groupBy("module").agg(F.sum(F.size("sets")).alias("tests"))

    def counted(sums: _Subsets, head: dict) -> list:
        sums.counts[sums.lists.value_lengths().to_numpy(zero_copy_only=False) == 0] = head["n"]
        return [pa.ListArray.from_arrays(pa.array(sums.first, pa.int32()), column) for column in (sums.lists, pa.array(sums.counts))]

    found = over_counts(vectors, lambda head, genes: _Subsets(head["sets"], genes), _Subsets.add, counted, "genes array<array<int>>; counts array<bigint>", grouped, load=load)
    return found.select(*CELL, F.inline(F.arrays_zip("genes", "counts"))).withColumnRenamed("counts", "members")


def placed_vectors(expr: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Cell vectors with ``place``: a rank of the cell inside its tie block, so that cells of a large block have many places."""
    inside = F.pmod(F.xxhash64("cell_id", "gene"), F.col("tie_size"))
    return cell_vectors(cell_neighborhoods(expr, fraction).withColumn("place", F.col("tie_start") + inside), "place")


def _paths(masks: np.ndarray, genes: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and the larger two of all gene triples, ``least`` their least, of which two pairs or more are set in the masks."""
    y, z = np.triu_indices(genes - least - 1, 1)
    y, z = y + least + 1, z + least + 1
    found, step = [], max(1, 2**22 // genes**2)
    for low in range(0, len(masks), step):
        row, a, b = mask_pairs(masks[low : low + step], genes)
        near = np.zeros((len(masks[low : low + step]), genes, genes), np.uint8)
        near[row, a, b] = 1
        at, pair = np.nonzero(near[:, least, y] + near[:, least, z] + near[:, y, z] > 1)
        found.append(((at + low).astype(np.int32), y[pair].astype(np.int32), z[pair].astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _add_paths(counts: np.ndarray, first: np.ndarray, rows: np.ndarray, keys: np.ndarray, members: np.ndarray) -> None:
    """Add for every set the members in the ranges of three genes: the first of ``members`` (members, genes) and those of ``rows``.

    ``keys`` (2, keys, genes) are ranges in the order of the first gene's; ``first`` tells where the sets of a key begin and ``rows``
    (2, sets) has key * genes + gene.  Members pass by in the order of the first gene, so a key meets those near it alone.
    """
    members = members[members[:, 0].argsort(kind="stable")]
    genes = members.shape[1]
    base = np.arange(genes)
    lo, hi = keys
    last_lo, last_hi = np.maximum.accumulate(lo[:, 0]), np.maximum.accumulate(hi[:, 0])
    for low in range(0, len(members), PREFIX_BLOCK):
        block = members[low : low + PREFIX_BLOCK]
        start, stop = np.searchsorted(last_hi, block[0, 0], "left"), np.searchsorted(last_lo, block[-1, 0], "right")
        if start >= stop:
            continue
        values, words = _prefix_words(block)
        wide, ones = words.shape[2], np.ones(words.shape[2], np.float32)
        words = words.reshape(-1, wide)
        left, right = np.empty((2, stop - start, genes), np.int64)
        for g, column in enumerate(values):
            left[:, g] = np.searchsorted(column, lo[start:stop, g], "left")
            right[:, g] = np.maximum(left[:, g], np.searchsorted(column, hi[start:stop, g], "right"))
        left += base * (len(block) + 1)
        right += base * (len(block) + 1)
        take = lambda table, at: table.take(at, axis=0, mode="clip")
        for at in range(start, stop, KEY_BLOCK):
            part = slice(at - start, min(at + KEY_BLOCK, stop) - start)
            bits = take(words, left[part].ravel())
            bits ^= take(words, right[part].ravel())
            bits = bits.reshape(-1, genes, wide)
            bits[:, 1:] &= bits[:, :1]
            flat = bits.reshape(-1, wide)
            sets, end = first[at], first[part.stop + start]
            for some in range(sets, end, 2048):
                own = slice(some, min(some + 2048, end))
                shared = take(flat, rows[0, own] - at * genes)
                shared &= take(flat, rows[1, own] - at * genes)
                # A block's members are few enough for exact single precision sums.
                counts[own] += (np.bitwise_count(shared).astype(np.float32) @ ones).astype(np.int32)


def path_counts(vectors: DataFrame, linked: DataFrame) -> DataFrame:
    """(module, cell_id, g0, g1, g2, members) for every triple g0 < g1 < g2 of which a cell's graph links two pairs or more.

    These are the sets of all tests given one gene.  ``vectors`` have ``place``; ``linked`` has genes and masks per cell.  A task
    takes one least gene and the cells whose places in it are close, makes their triples, and counts members in the order of that
    gene: only those that some key of the task may reach are sent to it.  No set is a row before it is counted.
    """
    cells = F.greatest(F.lit(KEY_BLOCK), F.least(F.lit(2**13), F.floor(F.lit(2 * HELD_SETS) / (F.size("own") * F.size("own")))))
    vectors = vectors.withColumn("_cells", cells.cast("bigint"))
    ends = vectors.select("module", "_cells", F.posexplode(F.arrays_zip("place", "lo", "hi")).alias("_x", "_e"))
    reached = ends.groupBy("module", "_x", F.floor(F.col("_e.place") / F.col("_cells")).cast("int").alias("_kb")).agg(
        F.min("_e.lo").alias("_low"), F.max("_e.hi").alias("_high"))
    names = ("_x", "_kb", "_low", "_high")
    listed = reached.groupBy("module").agg(F.collect_list(F.struct(*names)).alias("_r")).select("module", *[F.col(f"_r.{c}").alias(c) for c in names])
    block = F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n") / F.lit(MEMBER_BLOCK)))
    sides = ("own", "lo", "hi", "place", "masks")
    none = F.array().cast("array<bigint>")
    packed = vectors.join(linked.select(*CELL, "masks"), list(CELL), "left").withColumn("masks", F.coalesce("masks", none)).groupBy(
        "module", "_cells", block.alias("_block")).agg(F.collect_list(F.struct("cell_id", *sides)).alias("_v")).select(
        "module", "_cells", F.col("_v.cell_id").alias("cells"), F.transform("_v", lambda v: F.size(v["masks"])).alias("held"), *[F.flatten(f"_v.{c}").alias(c) for c in sides])
    # One row per module: sent to all tasks, as a join by module would bring all cells of a module to one.
    packed = packed.join(F.broadcast(listed), "module")
    dealt = "module string, _x int, _kb int, genes int, cells array<bigint>, side array<int>, masks array<bigint>"
    dealt_arrow = to_arrow_schema(T.StructType.fromDDL(dealt))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                module, size = batch.column("module")[row].as_py(), batch.column("_cells")[row].as_py()
                ids, held = _flat(batch, "cells", row), _flat(batch, "held", row) > 0
                own, lo, hi, place = (_flat(batch, c, row).reshape(len(ids), -1) for c in ("own", "lo", "hi", "place"))
                genes, keyed = own.shape[1], np.flatnonzero(held)
                masks = _flat(batch, "masks", row)
                masks = masks.reshape(len(keyed), len(masks) // max(len(keyed), 1))
                for x, kb, low, high in zip(*(_flat(batch, c, row).tolist() for c in names)):
                    if x > genes - 3:
                        continue
                    at = np.flatnonzero(place[keyed, x] // size == kb)
                    some = keyed[at]
                    near = (own[:, x] >= low) & (own[:, x] <= high)
                    rows = [(module, x, kb, genes, ids[some], np.stack((lo[some, x:], hi[some, x:])).ravel(), masks[at].ravel())] if len(at) else []
                    rows += [(module, x, kb, genes, None, own[near, x:].ravel(), None)] if near.any() else []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), dealt_arrow)], schema=dealt_arrow)

    answer = "module string, cell_id bigint, g0 int, g1 int, g2 int, members bigint"
    answer_arrow = to_arrow_schema(T.StructType.fromDDL(answer))

    def task(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, x = group[0].as_py(), group[1].as_py()
        ids, sides, masks, held, waiting, made = [], [], [], [], 0, None
        for batch in batches:
            for row in range(batch.num_rows):
                genes = batch.column("genes")[row].as_py()
                side = _flat(batch, "side", row)
                if batch.column("cells")[row].is_valid:
                    if made is not None:
                        raise RuntimeError("keys must come before members")
                    ids.append(_flat(batch, "cells", row))
                    sides.append(side.reshape(2, -1, genes - x))
                    masks.append(_flat(batch, "masks", row).reshape(len(ids[-1]), -1))
                    continue
                if not ids:  # no cell of this range has a link
                    return
                if made is None:
                    made = _sets_of(np.concatenate(ids), np.concatenate(sides, axis=1), np.concatenate(masks), genes, x)
                side = side.reshape(-1, genes - x)
                if held and waiting + len(side) > TURN_CELLS:
                    _add_paths(*made[1:], np.concatenate(held))
                    held, waiting = [], 0
                held.append(side)
                waiting += len(side)
        if held:
            _add_paths(*made[1:], np.concatenate(held))
        if made is None:
            return
        cells, counts, _, rows, _ = made
        for low in range(0, len(counts), 2**17):
            part = slice(low, low + 2**17)
            key, y = np.divmod(rows[0, part], genes - x)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(module, pa.string()), len(key)), pa.array(cells[key]), pa.array(np.full(len(key), x, np.int32)),
                pa.array(y + x), pa.array(rows[1, part] - key * (genes - x) + x), pa.array(counts[part].astype(np.int64))], schema=answer_arrow)

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    spread = packed.mapInArrow(deal, dealt).repartition(16 * cores, "module", "_x", "_kb")
    return spread.sortWithinPartitions("module", "_x", "_kb", F.col("cells").isNull()).groupBy("module", "_x", "_kb").applyInArrow(task, answer)


def _sets_of(ids: np.ndarray, keys: np.ndarray, masks: np.ndarray, genes: int, least: int) -> tuple:
    """Keys of a task in the order of their least gene's ranges; their triples, with a count of 0 for each."""
    turn = np.lexsort((keys[1, :, 0], keys[0, :, 0]))
    row, y, z = _paths(masks[turn], genes, least)
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    own = row * np.int32(genes - least)
    return ids[turn], np.zeros(len(row), np.int32), first, np.stack((own + y - np.int32(least), own + z - np.int32(least))), keys[:, turn]


class _Members:
    """Tie starts of all members of a module, (genes, members) at a time: in memory or, beyond ``HELD_STARTS``, in a file without a name."""

    def __init__(self, genes: int) -> None:
        self.genes, self.count, self.held, self.rest, self.file, self.stored = genes, 0, [], np.zeros((0, genes), np.int32), None, 0

    def add(self, own: np.ndarray) -> None:
        self.count += len(own)
        self.rest = np.concatenate((self.rest, own))
        while len(self.rest) >= COMPARED:
            block, self.rest = np.ascontiguousarray(self.rest[:COMPARED].T), self.rest[COMPARED:]
            if (len(self.held) + 1) * block.size <= HELD_STARTS:
                self.held.append(block)
                continue
            self.file = self.file or tempfile.TemporaryFile()
            block.tofile(self.file)
            self.stored += 1

    def _blocks(self) -> Iterator[np.ndarray]:
        yield from self.held
        if self.file:
            self.file.seek(0)
        for _ in range(self.stored):
            yield np.fromfile(self.file, np.int32, self.genes * COMPARED).reshape(self.genes, COMPARED)
        if len(self.rest):
            yield np.ascontiguousarray(self.rest.T)

    def pack(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Bits (keys, genes, words) telling which members fall in each key's range; keys of one range share the work."""
        keys, genes = lo.shape
        bits = np.empty((keys, genes, -(-self.count // 64)), np.uint64)
        wanted = []
        for g in range(genes):
            code, of = np.unique(lo[:, g].astype(np.int64) << 32 | hi[:, g].astype(np.int64), return_inverse=True)
            low, high = code >> 32, code & (2**32 - 1)
            wanted.append((low.astype(np.uint32)[:, None], np.maximum(high - low + 1, 0).astype(np.uint32)[:, None], of))
        gap, inside = np.empty((8, COMPARED), np.uint32), np.empty((8, COMPARED), bool)
        at = 0
        for block in self._blocks():
            many = block.shape[1]
            words = -(-many // 64)
            for g, (low, width, of) in enumerate(wanted):
                packed = np.zeros((len(low), words * 8), np.uint8)
                for some in range(0, len(low), 8):
                    part = slice(some, some + 8)
                    rows = len(low[part])
                    np.subtract(block[g].view(np.uint32), low[part], out=gap[:rows, :many])
                    np.less(gap[:rows, :many], width[part], out=inside[:rows, :many])
                    packed[part, : -(-many // 8)] = np.packbits(inside[:rows, :many], axis=1)
                bits[:, g, at : at + words] = packed.view(np.uint64)[of]
            at += words
        return bits


class SharedCounts:
    """Counts of the members that genes of one cell share, each set counted once; ``bits`` is (genes, words)."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.genes, self.known = bits, len(bits), {}
        self.single = np.array([_tally(row) for row in bits])

    def of(self, *genes: np.ndarray) -> np.ndarray:
        """Members that the genes of each set share; ``genes`` are arrays with one gene of every set."""
        code = reduce(lambda code, g: code * self.genes + g, np.sort(np.stack(genes).astype(np.int64), axis=0))
        if self.genes ** len(genes) > KNOWN_SETS:
            distinct, at = np.unique(code, return_inverse=True)
            return self._count(distinct, len(genes))[at]
        if len(genes) not in self.known:
            self.known[len(genes)] = np.full(self.genes ** len(genes), -1, np.int64 if self.bits.shape[1] > 2**24 else np.int32)
        table = self.known[len(genes)]
        fresh = np.unique(code[table[code] < 0])
        table[fresh] = self._count(fresh, len(genes))
        return table[code]

    def _count(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The count of each of ascending codes of sets."""
        words, places = self.bits.shape[1], [codes // self.genes ** k % self.genes for k in range(size - 1, -1, -1)]
        found = np.empty(len(codes), np.int64)
        rows = max(1, min(len(codes), ROOM // max(words, 1)))
        room = [np.empty((rows, words), np.uint64) for _ in range(2)]
        few = np.empty((rows, words), np.uint8)
        kind = np.float32 if words < 2**18 else np.float64  # sums stay exact
        whole, ones = np.empty((rows, words), kind), np.ones(words, kind)

        def tell(part: slice, shared: np.ndarray) -> None:
            here = len(shared)
            np.bitwise_count(shared, out=few[:here])
            np.copyto(whole[:here], few[:here])
            found[part] = whole[:here] @ ones

        bounds = np.flatnonzero(np.diff(codes // self.genes, prepend=-1))
        if len(codes) * words >= ROOM * len(bounds):  # many sets that differ in their last gene alone
            for start, stop in zip(bounds, np.append(bounds[1:], len(codes))):
                base = np.bitwise_and.reduce(self.bits[[p[start] for p in places[:-1]]], axis=0)
                for low in range(start, stop, rows):
                    part = slice(low, min(low + rows, stop))
                    shared, last = room[0][: part.stop - low], places[-1][part]
                    if last[-1] - last[0] == len(last) - 1:  # neighbours need no copy
                        own = self.bits[last[0] : last[-1] + 1]
                    else:
                        own = np.take(self.bits, last, axis=0, out=shared, mode="clip")
                    tell(part, np.bitwise_and(own, base, out=shared))
            return found
        for low in range(0, len(codes), rows):
            part = slice(low, min(low + rows, len(codes)))
            shared, other = (r[: part.stop - low] for r in room)
            np.take(self.bits, places[0][part], axis=0, out=shared, mode="clip")
            for place in places[1:]:
                np.take(self.bits, place[part], axis=0, out=other, mode="clip")
                np.bitwise_and(shared, other, out=shared)
            tell(part, shared)
        return found


def over_cells(vectors: DataFrame, visit: Callable[[np.ndarray, int, tuple], tuple], schema: str, extra: DataFrame, flat: bool = False) -> DataFrame:
    """Call ``visit(bits, n, extra_values)`` once per cell of ``extra``, whose further columns are arrays; ``bits`` is (genes, words).

    The values are arrays, one for each column of ``schema``: a row per cell, or with ``flat`` a row per entry.  Cells are dealt to a
    few tasks a core, and only there all members are sent: what is shuffled is a fixed multiple of the members, whatever is counted.  A
    task keeps at most ``HELD_STARTS`` values of members in memory and packs as many cells at a time as ``PACKED_WORDS`` allow.
    """
    tasks = TASKS * vectors.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.withColumn("_parts", F.least(F.ceil(F.col("n") / 16), F.lit(tasks)).cast("bigint"))
    fields = [c for c in extra.columns if c not in CELL]
    block = F.pmod(F.xxhash64("cell_id"), F.col("_parts") * F.ceil(F.col("n") / (F.col("_parts") * 1024)))
    keys = vectors.join(extra, list(CELL)).groupBy("module", block.alias("_block")).agg(
        F.first("n").alias("n"), F.first("_parts").alias("_parts"), F.collect_list(F.struct("cell_id", "lo", "hi", *fields)).alias("_k")
    ).select("module", F.pmod("_block", "_parts").cast("int").alias("_task"), "n", F.col("_k.cell_id").alias("cells"), F.flatten("_k.lo").alias("lo"),
             F.flatten("_k.hi").alias("hi"), *[F.col(f"_k.{f}").alias(f) for f in fields])
    members = vectors.groupBy("module", F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("n") / MEMBER_BLOCK)).alias("_mb")).agg(
        F.first("n").alias("n"), F.first("_parts").alias("_parts"), F.size(F.first("own")).alias("genes"), F.flatten(F.collect_list("own")).alias("own")
    ).select("module", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)).alias("_task"), "genes", "own")
    paired = keys.unionByName(members, allowMissingColumns=True)
    # One task a partition, but for the modules that share one.
    spread = paired.repartitionById(tasks, F.pmod(F.xxhash64("module") + F.col("_task"), F.lit(tasks)).cast("int"))
    full, arrow = _answers(schema)

    def rows(module: str, done: list[tuple]) -> pa.RecordBatch:
        cells, made = [c for c, _ in done], list(zip(*(values for _, values in done)))
        sizes = [len(v) for v in made[0]]
        columns = [pa.array(np.concatenate(c)) for c in made]
        if flat:
            cells = np.repeat(np.array(cells, np.int64), sizes)
        else:
            offsets = lambda column: pa.array(np.concatenate(([0], np.cumsum([len(v) for v in column]))).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets(c), values) for c, values in zip(made, columns)]
        first = [pa.array([module] * len(cells), pa.string()) if not flat else pa.repeat(pa.scalar(module, pa.string()), len(cells)), pa.array(cells, pa.int64())]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(first + columns, arrow)], schema=arrow)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                group = tuple(batch.column(c)[row].as_py() for c in ("module", "_task"))
                if group != at:
                    at, members = group, None
                if not batch.column("cells")[row].is_valid:
                    genes = batch.column("genes")[row].as_py()
                    members = members or _Members(genes)
                    members.add(_flat(batch, "own", row).reshape(-1, genes))
                    continue
                cells, n = _flat(batch, "cells", row), batch.column("n")[row].as_py()
                lo, hi = (_flat(batch, side, row).reshape(len(cells), -1) for side in ("lo", "hi"))
                values = [batch.column(f)[row].values for f in fields]
                step, done, held = max(1, PACKED_WORDS // (lo.shape[1] * -(-members.count // 64))), [], 0
                for low in range(0, len(cells), step):
                    bits = members.pack(lo[low : low + step], hi[low : low + step])
                    for i, own in enumerate(bits, low):
                        done.append((cells[i], visit(own, n, tuple(v[i].values.to_numpy(zero_copy_only=False) for v in values))))
                        held += sum(map(len, done[-1][1]))
                        if held > HELD_ROWS:
                            yield rows(at[0], done)
                            done, held = [], 0
                if done:
                    yield rows(at[0], done)

    return spread.sortWithinPartitions("module", "_task", F.col("cells").isNotNull()).mapInArrow(task, full)


def near_of(masks: np.ndarray, genes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs a < b of one cell and its (genes, genes) links, from the masks of its gene tiles."""
    _, a, b = mask_pairs(masks[None], genes)
    near = np.zeros((genes, genes), bool)
    near[a, b] = near[b, a] = True
    return a, b, near


def triple_counts(vectors: DataFrame, linked: DataFrame) -> DataFrame:
    """(module, cell_id, g0, g1, g2, members) for every triple g0 < g1 < g2 of which a cell's graph links two pairs or more.

    These are the sets of all tests given one gene.  ``linked`` has genes and masks per cell.
    """
    def visit(bits: np.ndarray, n: int, values: tuple) -> tuple:
        genes = len(bits)
        near = near_of(values[0], genes)[2].astype(np.int8)
        sets = [np.zeros((3, 0), np.int64)]
        for x in range(genes - 2):
            own = near[x, x + 1 :]
            y, z = np.nonzero(np.triu(near[x + 1 :, x + 1 :] + own[:, None] + own > 1, 1))
            sets.append(np.stack((np.full(len(y), x), y + x + 1, z + x + 1)))
        sets = np.concatenate(sets, axis=1)
        return *sets, SharedCounts(bits).of(*sets)

    return over_cells(vectors, visit, "g0 int; g1 int; g2 int; members bigint", linked.select(*CELL, "masks"), flat=True)


def joint_vectors(first: DataFrame, second: DataFrame, fraction: float, floor_at: float = 0.0, listed: DataFrame | None = None) -> DataFrame:
    """Cell vectors of two modalities side by side: the listed genes of the second follow those of the first, in gene order.

    ``second`` may leave out zeros; ``listed`` (module, gene) names its genes, those with entries if None.  All zeros of a gene
    share one neighbourhood, so a module's zero entries are one array, into which a cell's stored entries are set.
    """
    base = cell_vectors(cell_neighborhoods(first, fraction))
    sizes = first.groupBy("module", "gene").agg(F.count(F.lit(1)).alias("n")).groupBy("module").agg(F.max("n").alias("n"))
    genes = (second if listed is None else listed).select("module", "gene").distinct().join(sizes, "module")
    near, zeros = sparse_neighborhoods(second, genes, "n", fraction, floor_at)
    ends = ("tie_start", "lo_start", "hi_start")
    entry = F.struct("_at", *[F.col(e).cast("int").alias(e) for e in ends])
    place = F.row_number().over(W.partitionBy("module").orderBy("gene")) - 1  # a module's genes are few
    placed = genes.select("module", "gene", place.alias("_at"))
    blank = placed.join(zeros.drop("n"), ["module", "gene"], "left").groupBy("module").agg(F.array_sort(F.collect_list(entry)).alias("_z"))
    own = near.join(placed, ["module", "gene"]).groupBy(*CELL).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    both = base.join(own, list(CELL), "left").join(blank, "module", "left")
    none = F.array().cast("array<struct<_at: int, tie_start: int, lo_start: int, hi_start: int>>")
    both = both.withColumns({"_e": F.coalesce("_e", none), "_z": F.coalesce("_z", none)})
    before = lambda k: F.coalesce(F.get("_e", k)["_at"], F.lit(-1))
    set_in = F.flatten(F.transform("_e", lambda e, k: F.concat(F.slice("_z", before(k - 1) + 2, e["_at"] - before(k - 1) - 1), F.array(e))))
    last = before(F.size("_e") - 1)
    full = F.concat(set_in, F.slice("_z", last + 2, F.size("_z") - last - 1))
    joined = both.withColumn("_f", full)
    return joined.select(*CELL, "n", F.concat("own", "_f.tie_start").alias("own"), F.concat("lo", "_f.lo_start").alias("lo"), F.concat("hi", "_f.hi_start").alias("hi"))


def dyadic_pair_counts(ties: DataFrame, points: DataFrame) -> DataFrame:
    """Pair counts by dominance over power-of-two rank intervals.

    ``points`` has (module, a, b, va, vb, weight) per distinct value pair, ``ties`` is the output of
    ``tie_neighborhoods``.  Returns the same key with ``members``.
    """
    side = lambda g, v: ties.select(
        "module", F.col("gene").alias(g), F.col("value").alias(v),
        F.col("tie_start").alias(f"{g}_at"), F.col("lo_start").alias(f"{g}_lo"),
        (F.col("hi_start") + 1).alias(f"{g}_hi"), F.col("n").alias("n" if g == "a" else "_n"),
    )
    placed = points.join(side("a", "va"), ["module", "a", "va"]).join(side("b", "vb"), ["module", "b", "vb"])
    key = ["module", "a", "b"]
    levels = F.ceil(F.log2(F.col("n") + 1)).cast("int")
    stream = placed.select(
        *key, "va", "vb", F.col("a_at"), F.col("b_at"), F.col("weight").cast("long").alias("weight"), levels.alias("_levels"),
        "a_lo", "a_hi", "b_lo", "b_hi",
    )
    # A prefix of ranks is the union of one interval per set bit, always an even-numbered one.
    at = stream.select(
        *key, F.col("weight"), F.col("b_at").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("level"), "a_at"
    ).withColumn("node", F.floor(F.col("a_at") / F.pow(F.lit(2.0), F.col("level"))).cast("long")).filter(F.col("node") % 2 == 0)
    points_in = at.select(
        *key, "level", "node", "y", F.lit(1).alias("kind"), "weight",
        F.lit(None).cast("double").alias("va"), F.lit(None).cast("double").alias("vb"), F.lit(0).alias("sign"),
    )
    corners = F.array(
        *[
            F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(sign).alias("sign"))
            for x, y, sign in (("a_hi", "b_hi", 1), ("a_lo", "b_hi", -1), ("a_hi", "b_lo", -1), ("a_lo", "b_lo", 1))
        ]
    )
    inverted = (F.col("a_hi") <= F.col("a_lo")) | (F.col("b_hi") <= F.col("b_lo"))
    asked = (
        stream.filter(~inverted)
        .select(*key, "va", "vb", "_levels", F.inline(corners))
        .select(*key, "va", "vb", "x", "y", "sign", F.explode(F.sequence(F.lit(0), F.col("_levels"))).alias("level"))
        .withColumn("_prefix", F.floor(F.col("x") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
        .filter(F.col("_prefix") % 2 == 1)
        .select(
            *key, "level", (F.col("_prefix") - 1).alias("node"), "y", F.lit(0).alias("kind"),
            F.lit(0).cast("long").alias("weight"), "va", "vb", "sign",
        )
    )
    both = points_in.unionByName(asked).withColumn("_block", F.floor(F.col("y") / F.lit(65536)))
    counted = running_total(both, [*key, "level", "node"], "_block", [F.col("y"), F.col("kind")], F.col("weight"), "below")
    totals = (
        counted.filter(F.col("kind") == 0)
        .groupBy(*key, "va", "vb")
        .agg(F.sum(F.col("sign") * F.col("below")).alias("members"))
    )
    return points.join(totals, [*key, "va", "vb"], "left").withColumn("members", F.coalesce("members", F.lit(0)).cast("long"))
