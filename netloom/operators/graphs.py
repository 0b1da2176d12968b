"""Compact graph rows, their decoding, degrees, reachability and order.

A linked graph is one row with the arrays ``src`` and ``dst`` of its edges, ordered and without repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

HELD_BITS = 2**22  # cells of adjacency matrices that a task holds as bytes


def over_rows(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], columns: str, gone: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with further ``columns`` that ``work`` makes from its Arrow batches, without those ``gone``."""
    kept = [f for f in df.schema.fields if f.name not in gone]
    full = T.StructType([*kept, *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(full)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            made = [*(batch.column(f.name) for f in kept), *work(batch)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(batches, full)


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row of every entry of a list column, and the entries; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def list_of(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """A list column from ascending row numbers and values."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def adjacency(batch: pa.RecordBatch, src: str, dst: str, nodes: int) -> np.ndarray:
    """Bits (rows, nodes, words): which nodes each node has an edge to."""
    dense = np.zeros((batch.num_rows, nodes, -(-nodes // 64) * 64), bool)
    (row, s), (_, d) = list_parts(batch.column(src)), list_parts(batch.column(dst))
    dense[row, s, d] = True
    return np.packbits(dense, axis=2, bitorder="little").view(np.uint64)


def spread_bits(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=2, bitorder="little")[:, :, : bits.shape[1]]


def by_matrix(batch: pa.RecordBatch, work: Callable[[pa.RecordBatch, int], np.ndarray], names: tuple[str, ...]) -> list[pa.Array]:
    """Edge lists from the adjacency bits that ``work(rows, nodes)`` makes of a few rows at a time; ``names`` are the columns with nodes."""
    nodes = 1 + max(int(np.max(batch.column(c).flatten().to_numpy(zero_copy_only=False), initial=-1)) for c in names)
    if not nodes:
        return [list_of(np.zeros(0, np.int64), np.zeros(0, np.int32), batch.num_rows)] * 2
    step, found = max(1, HELD_BITS // (nodes * (nodes + 63))), []
    for low in range(0, batch.num_rows, step):
        row, s, d = np.nonzero(spread_bits(work(batch.slice(low, step), nodes)))
        found.append((row + low, s.astype(np.int32), d.astype(np.int32)))
    row, s, d = (np.concatenate(c) for c in zip(*found))
    return [list_of(row, s, batch.num_rows), list_of(row, d, batch.num_rows)]


def linked_edges(linked: DataFrame, *more: str) -> DataFrame:
    """(key, src, dst) rows of linked graphs, with further columns that have an entry per edge."""
    key = [c for c in linked.columns if c not in ("n_genes", "src", "dst", *more)]
    return linked.select(*key, F.inline(F.arrays_zip("src", "dst", *more)))


def pack_linked(linked: DataFrame) -> DataFrame:
    """``pack_graphs`` of linked graphs with ``n_genes``: each row is packed where it is."""
    def pack(batch: pa.RecordBatch) -> list[pa.Array]:
        row, src = list_parts(batch.column("src"))
        genes = batch.column("n_genes").to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(genes + 1)))  # a place before each graph's nodes holds its 0
        fan = np.bincount(first[row] + src + 1, minlength=first[-1])
        upto = np.cumsum(fan)
        whole = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(genes)))))
        ptr = (upto - np.repeat(whole[:-1], genes + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ptr))]

    key = [c for c in linked.columns if c not in ("n_genes", "src", "dst")]
    none = F.array().cast("array<int>")
    return over_rows(linked, pack, "node_ptr array<int>", ("src",)).select(*key, "n_genes", "node_ptr", F.coalesce("dst", none).alias("targets"))


def pack_graphs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per graph: ``node_ptr`` (n + 1 running out-degrees) and ``targets`` ordered by (src, dst).

    ``nodes`` gives ``n_genes`` per key, so graphs without edges appear.
    """
    key = [c for c in nodes.columns if c != "n_genes"]
    fan = edges.distinct().groupBy(*key, "src").agg(F.array_sort(F.collect_list("dst")).alias("to"))
    packed = fan.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("src", "to"))).alias("_e"))
    upto = W.partitionBy(*key).orderBy("src")
    totals = fan.withColumn("upto", F.sum(F.size("to")).over(upto).cast("int")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("src", "upto"))).alias("_t"))
    # The pointer of node i is the total of the last source before it, so each total repeats up to the next source.
    before = lambda k, name, otherwise: F.coalesce(F.get("_t", k)[name], F.lit(otherwise))
    steps = F.transform("_t", lambda e, k: F.array_repeat(before(k - 1, "upto", 0), e["src"] - before(k - 1, "src", -1)))
    rest = F.array_repeat(before(F.size("_t") - 1, "upto", 0), F.col("n_genes").cast("int") - before(F.size("_t") - 1, "src", -1))
    none = F.array().cast("array<int>")
    linked = nodes.join(packed, key, "left").join(totals, key, "left")
    empty = F.array_repeat(F.lit(0), F.col("n_genes").cast("int") + 1)
    return linked.select(
        *key, "n_genes",
        F.when(F.col("_t").isNull(), empty).otherwise(F.concat(F.flatten(steps), rest)).alias("node_ptr"),
        F.coalesce(F.flatten(F.col("_e.to")), none).alias("targets"),
    )


def decode_graphs(packed: DataFrame) -> DataFrame:
    """(key, src, dst) rows of packed graphs."""
    key = [c for c in packed.columns if c not in ("n_genes", "node_ptr", "targets", "topo_order")]
    fan = F.expr("transform(slice(node_ptr, 2, size(node_ptr) - 1), (stop, i) -> array_repeat(i, stop - node_ptr[i]))")
    return packed.select(*key, F.inline(F.arrays_zip(F.flatten(fan).alias("src"), F.col("targets").alias("dst"))))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Out- and in-degree of every node that has one, or of all ``nodes`` (key, gene)."""
    key = [c for c in edges.columns if c not in ("src", "dst")]
    ends = edges.select(
        *key,
        F.inline(F.array(F.struct(F.col("src").alias("gene"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                         F.struct(F.col("dst").alias("gene"), F.lit(0).alias("o"), F.lit(1).alias("i")))),
    )
    counted = ends.groupBy(*key, "gene").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    if nodes is None:
        return counted
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return nodes.join(counted, [*key, "gene"], "left").select(*key, "gene", zero("out_degree"), zero("in_degree"))


def directed_only(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is absent."""
    key = [c for c in edges.columns if c not in ("src", "dst")]
    reverse = edges.select(*key, F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(reverse, edges.columns, "left_anti")


def mutual_only(edges: DataFrame) -> DataFrame:
    """Edges present in both directions."""
    key = [c for c in edges.columns if c not in ("src", "dst")]
    reverse = edges.select(*key, F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(reverse, edges.columns, "left_semi")


def successor_closure(linked: DataFrame) -> DataFrame:
    """(key, src, dst) for every directed path of linked graphs, searched inside each row."""
    def search(rows: pa.RecordBatch, nodes: int) -> np.ndarray:
        reach = adjacency(rows, "src", "dst", nodes)
        for v in range(nodes):  # paths that pass no node above v
            through = reach[:, :, v // 64] >> np.uint64(v % 64) & np.uint64(1)
            reach |= (np.uint64(0) - through)[:, :, None] & reach[:, v, None]
        return reach

    key = linked.drop("n_genes", "src", "dst").columns
    paths = over_rows(linked, lambda batch: by_matrix(batch, search, ("src", "dst")), "_src array<int>, _dst array<int>", ("src", "dst"))
    return linked_edges(paths.select(*key, F.col("_src").alias("src"), F.col("_dst").alias("dst")))


def _dependency_order(ptr, to) -> list[int]:
    n = len(ptr) - 1
    waiting = [0] * n
    for d in to:
        waiting[d] += 1
    ready = [v for v in range(n) if not waiting[v]]
    done: list[int] = []
    while ready:
        done.extend(ready)
        following = []
        for v in ready:
            for d in to[ptr[v]:ptr[v + 1]]:
                waiting[d] -= 1
                if not waiting[d]:
                    following.append(int(d))
        ready = sorted(following)
    return done if len(done) == n else [-1] * n


def topological_orders(packed: DataFrame) -> DataFrame:
    """Add ``topo_order``: nodes in dependency order, smallest first among the ready; all -1 if cyclic."""
    def batches(frames):
        for frame in frames:
            orders = [_dependency_order(p, t) for p, t in zip(frame["node_ptr"], frame["targets"])]
            yield frame.assign(topo_order=pd.Series(orders, index=frame.index, dtype=object))

    schema = ", ".join(f"{name} {kind}" for name, kind in packed.dtypes) + ", topo_order array<int>"
    return packed.mapInPandas(batches, schema)


def edges_in(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges found in a set of (src, dst) pairs."""
    on = [c for c in ("module", "src", "dst") if c in pairs.columns]
    return edges.join(pairs.select(*on), on, "left_semi")


def best_combination(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted set (set_id, gene), the group (group_id, gene) sharing most genes; lowest id on ties."""
    shared = members.join(wanted, "gene").groupBy("set_id", "group_id").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.groupBy("set_id").agg(
        F.max_by("group_id", F.struct("overlap", -F.col("group_id"))).alias("group_id"), F.max("overlap").alias("overlap")
    )
