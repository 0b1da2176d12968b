"""Cells x genes scores from graphs and expression."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graphs, katz, priors
from ..session import cut_lineage
from ..sources import files
from .run import GRAPHS, NODE_VALUES, read_by_module, written_modules


def score_cells(edges: DataFrame, expr: DataFrame, genes: DataFrame, alpha: float = 0.05, beta_mode: str = "expression",
                beta_lambda: float = 1.0, weights: DataFrame | None = None, weight_lambda: float = 1.0, mode: str = "sum") -> DataFrame:
    """(cell_id, gene name, score), the first module winning for repeated genes."""
    if not 0.0 <= beta_lambda <= 1.0:
        raise ValueError("beta_lambda must be within [0, 1]")
    if weight_lambda < 0.0:
        raise ValueError("edge weight lambda must be >= 0")
    coef = katz.edge_coefficients(edges, weights, weight_lambda, mode)
    scores = katz.propagate(coef, katz.node_weights(expr, beta_mode, beta_lambda), alpha, least_squares=weights is not None or mode != "sum")
    named = scores.join(genes, ["module", "gene"]).select("module", "cell_id", F.col("name").alias("gene"), "score")
    return katz.first_module_scores(named)


def _with_factors(spark, expr, genes, cells, modules: list[str], result_dir: str) -> tuple[DataFrame, DataFrame]:
    """Modules run on factors score their factors."""
    path = f"{result_dir}/{NODE_VALUES}"
    reduced = sorted(written_modules(spark, path) & set(modules))
    if not reduced:
        return expr, genes
    other = ~F.col("module").isin(reduced)
    values = read_by_module(spark, path, reduced).join(cells, "barcode").select("module", "cell_id", "gene", "value")
    names = values.select("module", "gene").distinct().withColumn("name", F.format_string("factor_%03d", F.col("gene")))
    return expr.filter(other).unionByName(values), genes.filter(other).unionByName(names)


def in_every_module(expr: DataFrame, modules: int) -> DataFrame:
    """(cell_id) of the cells that all modules hold: the rows of an inner merge of the modules on barcode."""
    return expr.select("module", "cell_id").distinct().groupBy("cell_id").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") == modules).select("cell_id")


def build_scores(spark: SparkSession, module_dir: str, result_dir: str, out: str | None = None, alpha: float = 0.05,
                 beta_mode: str = "expression", beta_lambda: float = 1.0, edge_weight_mode: str = "binary",
                 edge_weight_lambda: float = 1.0, tf_top_k: int = 20, propagation_mode: str = "sum") -> DataFrame:
    """Read a module folder and its results; returns, and optionally writes as CSV, the wide score matrix.

    Graphs meet their values by barcode, not by row position.
    """
    listed = files.module_files(spark, module_dir)
    missing = sorted(set(listed) - written_modules(spark, f"{result_dir}/{GRAPHS}"))
    if missing:
        raise FileNotFoundError(f"no results for {missing}")
    expr, genes, cells = files.read_modules(spark, listed)
    expr, genes = _with_factors(spark, expr, genes, cells, list(listed), result_dir)
    packed = read_by_module(spark, f"{result_dir}/{GRAPHS}", list(listed)).drop("cell_id").join(cells, "barcode")
    counted = packed.groupBy("module").agg(F.count(F.lit(1)).alias("g"), F.first("n_genes").alias("k")).join(
        expr.groupBy("module").agg(F.countDistinct("cell_id").alias("e"), F.countDistinct("gene").alias("v")), "module")
    wrong = counted.filter("g <> e or k <> v")
    if not wrong.isEmpty():
        raise ValueError(f"graphs and values disagree in size: {wrong.first().asDict()}")
    edges = graphs.decode_graphs(packed.select("module", "cell_id", "n_genes", "node_ptr", "targets"))
    weights = None
    if edge_weight_mode == "tf_prior":
        raw = files.read_side_files(spark, listed, "_tf_target_prior.csv")
        if raw is not None:
            weights = cut_lineage(priors.prior_weights(priors.target_prior(raw, genes, tf_top_k, strict=False)))
    elif edge_weight_mode != "binary":
        raise ValueError(f"unsupported edge_weight_mode: {edge_weight_mode}")
    scores = score_cells(edges, expr, genes, alpha, beta_mode, beta_lambda, weights, edge_weight_lambda, propagation_mode)
    # Columns stand where their name comes first; rows are the cells that every module has.
    first = genes.groupBy("name").agg(F.min(F.struct("module", "gene")).alias("at")).orderBy("at")
    order = [r["name"] for r in first.select("name").toLocalIterator()]
    shared = in_every_module(expr, len(listed))
    wide = katz.score_matrix(scores.join(shared, "cell_id", "left_semi").join(cells, "cell_id"), order, "barcode")
    if out:
        files.write_csv(wide, out)
    return wide
