"""Correlation, soft-threshold adjacency and topological overlap.

All three are Gram matrices.  Rows are read once; every task adds up its own genes x genes product with numpy
and only those partial sums are shuffled, so the cost does not depend on any key's share of the rows.  Columns
are cut into tiles when a full product would not fit a task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ranks import average_rank, group_stats

TILE = 1024
HELD_BLOCKS = 64
TINY = 1e-8


def dense_vectors(df: DataFrame, row: str, column: str, value: str, n_columns: int, group: str = "module") -> DataFrame:
    """(group, row, v): values in column order, absent columns as 0; a column outside 0..n_columns-1 is an error."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(column).alias("i"), F.col(value).cast("double").alias("v"))))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    place = lambda k: F.coalesce(F.get("_e", k)["i"], F.lit(-1))
    gaps = F.transform("_e", lambda e, k: F.concat(zeros(e["i"] - place(k - 1) - 1), F.array(e["v"])))
    filled = F.concat(F.flatten(gaps), zeros(F.lit(n_columns - 1) - place(F.size("_e") - 1)))
    outside = (place(F.lit(0)) < 0) | (place(F.size("_e") - 1) >= n_columns)
    vector = (
        F.when(outside, F.raise_error(F.lit(f"{column} outside 0..{n_columns - 1}")))
        .when(F.size("_e") == n_columns, F.col("_e.v")).otherwise(filled)
    )
    return df.withColumn(column, F.col(column).cast("int")).groupBy(group, row).agg(entries.alias("_e")).select(group, row, vector.alias("v"))


def gram(vectors: DataFrame, n_columns: int, group: str = "module", tile: int = TILE) -> DataFrame:
    """(group, i, j, product) for i <= j: sum over rows of v[i] * v[j]."""
    tiles = range(-(-n_columns // tile))
    part = lambda t: F.slice("v", t * tile + 1, tile)
    pairs = F.array(*[
        F.struct(F.lit(i).alias("ti"), F.lit(j).alias("tj"), part(i).alias("left"), part(j).alias("right"))
        for i in tiles for j in tiles if i <= j
    ])
    spread = vectors.select(F.col(group).cast("string").alias("g"), F.inline(pairs))

    def partial(batches):
        sums: dict = {}

        def flush():
            for (g, i, j), block in sums.items():
                yield pa.RecordBatch.from_pydict(
                    {"g": [g], "ti": pa.array([i], pa.int32()), "tj": pa.array([j], pa.int32()),
                     "width": pa.array([block.shape[1]], pa.int32()), "block": [block.ravel()]}
                )
            sums.clear()

        for batch in batches:
            rows = defaultdict(list)
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "ti", "tj")))):
                rows[key].append(at)
            for key, at in rows.items():
                picked = batch.take(pa.array(at))
                left, right = (picked.column(c).flatten().to_numpy().reshape(len(at), -1) for c in ("left", "right"))
                block = left.T @ right
                sums[key] = sums[key] + block if key in sums else block
            if len(sums) > HELD_BLOCKS:
                yield from flush()
        yield from flush()

    blocks = spread.mapInArrow(partial, "g string, ti int, tj int, width int, block array<double>")
    cells = blocks.select("g", "ti", "tj", "width", F.posexplode("block").alias("p", "v"))
    i = (F.col("ti") * tile + F.floor(F.col("p") / F.col("width"))).cast("int")
    j = (F.col("tj") * tile + F.col("p") % F.col("width")).cast("int")
    return (
        cells.select(F.col("g").alias(group), i.alias("i"), j.alias("j"), "v")
        .filter("i <= j")
        .groupBy(group, "i", "j")
        .agg(F.sum("v").alias("product"))
    )


def correlations(expr: DataFrame, n_genes: int, row: str = "cell_id", value: str = "value") -> DataFrame:
    """Pearson (module, i, j, corr) for i <= j: constant columns correlate 0 with others, the diagonal is 1."""
    v = F.col(value)
    stats = group_stats(expr, ["module", "gene"], F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"), F.count(v).alias("_n"))
    norm = F.sqrt(F.col("_var") * F.col("_n"))
    unit = stats.withColumn("_z", F.when(norm > TINY, (v - F.col("_mean")) / norm).otherwise(F.lit(0.0)))
    product = gram(dense_vectors(unit, row, "gene", "_z", n_genes), n_genes)
    clipped = F.least(F.greatest("product", F.lit(-1.0)), F.lit(1.0))
    return product.select("module", "i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(clipped).alias("corr"))


def rank_correlations(expr: DataFrame, n_genes: int) -> DataFrame:
    """Spearman: Pearson on average ranks."""
    return correlations(average_rank(expr, ["module", "gene"], "value", "rank"), n_genes, value="rank")


def adjacency(corr: DataFrame, power: int = 6) -> DataFrame:
    """|corr| to the given power off the diagonal, 0 on it."""
    strength = F.pow(F.abs("corr"), F.lit(float(power)))
    return corr.select("module", "i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(strength).alias("adjacency"))


def mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """Both orders of i <= j rows."""
    flipped = pairs.filter("i < j").select("module", F.col("j").alias("i"), F.col("i").alias("j"), value)
    return pairs.select("module", "i", "j", value).unionByName(flipped)


def topological_overlap(adj: DataFrame, n_genes: int) -> DataFrame:
    """(shared + a) / (min degree + 1 - a) for i <= j, 1 on the diagonal."""
    full = mirrored(adj, "adjacency")
    shared = gram(dense_vectors(full, "i", "j", "adjacency", n_genes), n_genes).withColumnRenamed("product", "shared")
    degree = full.groupBy("module", "i").agg(F.sum("adjacency").alias("k"))
    a = F.col("adjacency")
    denominator = F.least("k_i", "k_j") + 1.0 - a
    overlap = F.when(denominator > TINY, (F.col("shared") + a) / denominator).otherwise(F.lit(0.0))
    return (
        adj.join(shared, ["module", "i", "j"])
        .join(degree.withColumnRenamed("k", "k_i"), ["module", "i"])
        .join(degree.select("module", F.col("i").alias("j"), F.col("k").alias("k_j")), ["module", "j"])
        .select("module", "i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(overlap).alias("tom"))
    )
