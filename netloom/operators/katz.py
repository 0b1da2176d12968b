"""Propagation of node values along each cell's graph: v = beta + alpha * sum of coef * v(successor)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graphs import list_parts, over_rows
from .ranks import group_stats, ordinal_rank_scale

# Smallest usable denominator, range of the clipped blend.
TINY = 1e-8
CLIP = (0.0, 3.0)


def edge_coefficients(edges: DataFrame, weights: DataFrame | None = None, weight_lambda: float = 1.0,
                      mode: str = "sum") -> DataFrame:
    """Edges with ``coef``: 1 + lambda * prior weight, divided by the source's or both ends' totals."""
    key = [c for c in edges.columns if c not in ("src", "dst")]
    if weights is None:
        weighted = edges.withColumn("coef", F.lit(1.0))
    else:
        on = [c for c in ("module", "src", "dst") if c in weights.columns and c in edges.columns]
        weighted = edges.join(weights.select(*on, "w"), on, "left").select(
            *key, "src", "dst",
            F.when(F.col("w") > 0, 1.0 + F.lit(float(weight_lambda)) * F.col("w")).otherwise(F.lit(1.0)).alias("coef"),
        )
    if mode == "sum":
        return weighted
    out = weighted.groupBy(*key, "src").agg(F.sum("coef").alias("_out"))
    scaled = weighted.join(out, [*key, "src"])
    if mode == "mean_out":
        divisor = F.col("_out")
    elif mode == "sym_degree":
        into = weighted.groupBy(*key, "dst").agg(F.sum("coef").alias("_in"))
        scaled = scaled.join(into, [*key, "dst"])
        divisor = F.sqrt(F.col("_out") * F.col("_in"))
    else:
        raise ValueError(f"unsupported propagation mode: {mode}")
    coef = F.when(divisor > TINY, F.col("coef") / divisor).otherwise(F.col("coef"))
    return scaled.select(*key, "src", "dst", coef.alias("coef"))


def linked_coefficients(linked: DataFrame, weights: DataFrame | None = None, weight_lambda: float = 1.0, mode: str = "sum") -> DataFrame:
    """``edge_coefficients`` of linked graphs: the array ``coef`` beside ``src`` and ``dst``; ``weights`` has module, src, dst and w."""
    if mode not in ("sum", "mean_out", "sym_degree"):
        raise ValueError(f"unsupported propagation mode: {mode}")
    listed = ("_w_src", "_w_dst", "_w") if weights is not None else ()
    if weights is not None:
        held = weights.filter("w > 0").groupBy("module").agg(F.collect_list(F.struct("src", "dst", "w")).alias("_l"))
        # One row per module: sent to all tasks, as a join by module would bring all cells of a module to one.
        linked = linked.join(F.broadcast(held.select("module", *[F.col(f"_l.{c}").alias(n) for c, n in zip(("src", "dst", "w"), listed)])), "module", "left")

    def weigh(batch: pa.RecordBatch) -> list[pa.Array]:
        (row, src), (_, dst) = list_parts(batch.column("src")), list_parts(batch.column("dst"))
        src, dst, coef = src.astype(np.int64), dst.astype(np.int64), np.ones(len(row))
        span = 1 + int(max(np.max(src, initial=0), np.max(dst, initial=0)))
        if listed and len(row):
            modules = np.unique(batch.column("module").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            for m, first in enumerate(modules[1]):
                s, d, w = (list_parts(batch.column(c).slice(first, 1))[1] for c in listed)
                known = (s < span) & (d < span)
                table = np.zeros((span, span))
                table[s[known], d[known]] = w[known]
                own = modules[2][row] == m
                coef[own] += weight_lambda * table[src[own], dst[own]]
        total = lambda node: np.bincount(row * span + node, coef)[row * span + node]
        if mode != "sum" and len(row):
            divisor = total(src) if mode == "mean_out" else np.sqrt(total(src) * total(dst))
            coef = np.where(divisor > TINY, coef / np.maximum(divisor, TINY), coef)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(coef))]

    return over_rows(linked, weigh, "coef array<double>", listed)


def node_weights(values: DataFrame, mode: str = "expression", blend: float = 1.0) -> DataFrame:
    """Starting value ``beta`` per (module, cell, gene)."""
    group = ["module", "gene"]
    blended = lambda c: F.lit(float(blend)) * c + F.lit(1.0 - float(blend))
    if mode == "expression":
        return values.withColumn("beta", F.col("value").cast("double"))
    if mode == "uniform":
        return values.withColumn("beta", F.lit(1.0))
    if mode == "rank_blend":
        return ordinal_rank_scale(values, group, out="_s").withColumn("beta", blended(F.col("_s"))).drop("_s")
    if mode not in ("blend", "clipped_blend"):
        raise ValueError(f"unsupported beta mode: {mode}")
    scaled = column_mean_scale(values, group)
    share = F.col("scaled")
    if mode == "clipped_blend":
        share = F.least(F.greatest(share, F.lit(CLIP[0])), F.lit(CLIP[1]))
    return scaled.withColumn("beta", blended(share)).drop("scaled")


def column_mean_scale(values: DataFrame, group: list[str], out: str = "scaled") -> DataFrame:
    """Divide by the group's mean unless that is within 1e-8 of zero."""
    means = group_stats(values, group, F.avg("value").alias("_mean"))
    safe = F.when(F.abs("_mean") > TINY, F.col("_mean")).otherwise(F.lit(1.0))
    return means.withColumn(out, F.col("value") / safe).drop("_mean")


def propagate(coefficients: DataFrame, beta: DataFrame, alpha: float = 0.05, least_squares: bool = True) -> DataFrame:
    """``propagate_linked`` over rows of coefficients (key, src, dst, coef)."""
    key = [c for c in coefficients.columns if c not in ("src", "dst", "coef")]
    arcs = coefficients.groupBy(*key).agg(F.collect_list(F.struct("src", "dst", "coef")).alias("_a"))
    return propagate_linked(arcs.select(*key, *[F.col(f"_a.{c}").alias(c) for c in ("src", "dst", "coef")]), beta, alpha, least_squares)


def propagate_linked(arcs: DataFrame, beta: DataFrame, alpha: float = 0.05, least_squares: bool = True) -> DataFrame:
    """Score per (module, cell, gene); cells without edges keep beta.  ``arcs`` has the arrays src, dst and coef per key.

    All cells of a batch are substituted at once along their edges.  An acyclic graph stands still after at most as
    many steps as it has genes; graphs that do not are cyclic and solved one by one.  A singular system falls back
    to least squares if asked, else fails.
    """
    key = [c for c in arcs.columns if c not in ("n_genes", "src", "dst", "coef")]
    start = beta.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("gene", "beta"))).alias("_b"))
    rows = start.join(arcs, key, "left").select(*key, F.col("_b.gene").alias("genes"), F.col("_b.beta").alias("beta"), "src", "dst", "coef")

    def dense(b, s, d, step):
        system = np.eye(len(b))
        np.subtract.at(system, (s, d), step)
        try:
            return np.linalg.solve(system, b)
        except np.linalg.LinAlgError:
            if not least_squares:
                raise
            return np.linalg.lstsq(system, b, rcond=None)[0]

    @F.pandas_udf("array<double>")
    def solve(genes: pd.Series, beta: pd.Series, src: pd.Series, dst: pd.Series, coef: pd.Series) -> pd.Series:
        none = np.empty(0)
        src, dst, coef = ([none if x is None else x for x in column] for column in (src, dst, coef))
        width, edges = np.array([len(g) for g in genes]), np.array([len(s) for s in src])
        starts, edge_starts = np.r_[0, np.cumsum(width)], np.r_[0, np.cumsum(edges)]
        fixed = np.concatenate([none, *beta]).astype(float)
        nodes = pd.MultiIndex.from_arrays([np.repeat(np.arange(len(width)), width), np.concatenate(list(genes))])
        v, left = fixed.copy(), np.empty(0, int)
        if edges.any():
            owner = np.repeat(np.arange(len(width)), edges)
            ends = [nodes.get_indexer(pd.MultiIndex.from_arrays([owner, np.concatenate([p for p in part if len(p)])])) for part in (src, dst)]
            if min(e.min() for e in ends) < 0:
                raise KeyError("an edge names a gene without a value")
            step = alpha * np.concatenate([c for c in coef if len(c)]).astype(float)
            with np.errstate(over="ignore", invalid="ignore"):  # cyclic graphs may grow until they are set aside
                for _ in range(int(width.max()) + 1):
                    before = v
                    v = fixed + np.bincount(ends[0], step * before[ends[1]], minlength=len(fixed))
                    if np.array_equal(v, before):
                        break
            left = np.unique(np.repeat(np.arange(len(width)), width)[(v != before) | ~np.isfinite(v)])
        for i in left:
            own, arcs = slice(starts[i], starts[i + 1]), slice(edge_starts[i], edge_starts[i + 1])
            v[own] = dense(fixed[own], ends[0][arcs] - starts[i], ends[1][arcs] - starts[i], step[arcs])
        return pd.Series([v[starts[i]:starts[i + 1]] for i in range(len(width))])

    solved = rows.withColumn("score", solve("genes", "beta", "src", "dst", "coef"))
    return solved.select(*key, F.inline(F.arrays_zip(F.col("genes").alias("gene"), F.col("score"))))


def first_module_scores(scores: DataFrame) -> DataFrame:
    """(cell, gene name, score), the first module winning where a gene sits in several."""
    return scores.groupBy("cell_id", "gene").agg(F.min_by("score", "module").alias("score"))


def score_matrix(scores: DataFrame, genes: list[str] | None = None, row: str = "cell_id") -> DataFrame:
    """Wide cells x genes frame."""
    pivot = scores.groupBy(row).pivot("gene", genes) if genes else scores.groupBy(row).pivot("gene")
    return pivot.agg(F.first("score"))
