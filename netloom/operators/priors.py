"""Pair priors, directed priors and the constraints made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import effective_alpha
from .ranks import top_k, zero_preserving_rank

# Strength columns in order of preference.
STRENGTH_COLUMNS = ("prior_strength", "coarse_edge_frequency", "coarse_edge_count")


def require_columns(df: DataFrame, names: set[str], what: str) -> None:
    missing = names - set(df.columns)
    if missing:
        raise ValueError(f"{what} must contain columns: {sorted(names)}")


def pair_prior(raw: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, a, b, w) with a < b by name: the strongest listing of each unordered pair.

    Blank and self pairs are dropped.  Without a strength column every pair weighs 1; counts are divided by the
    largest count of the group.
    """
    require_columns(raw, {"gene_left", "gene_right"}, "pair prior")
    group = group or []
    left, right = F.trim(F.col("gene_left").cast("string")), F.trim(F.col("gene_right").cast("string"))
    column = next((c for c in STRENGTH_COLUMNS if c in raw.columns), None)
    rows = raw
    if column is None:
        strength = F.lit(1.0)
    else:
        strength = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        if column == "coarse_edge_count":
            if group:
                rows = raw.join(raw.groupBy(*group).agg(F.max(F.col(column).cast("double")).alias("_top")), group)
            else:
                rows = raw.withColumn("_top", raw.agg(F.max(F.col(column).cast("double"))).scalar())
            strength = strength / F.greatest(F.col("_top"), F.lit(1.0))
    w = F.least(F.greatest(strength, F.lit(0.0)), F.lit(1.0))
    return (
        rows.select(*group, F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), w.alias("w"))
        .filter("a <> '' and b <> '' and a <> b and w > 0")
        .groupBy(*group, "a", "b")
        .agg(F.max("w").alias("w"))
    )


def strong_pairs(prior: DataFrame, least: float = 0.0, binary: bool = False) -> DataFrame:
    """Pairs at or above a strength; ``binary`` keeps the pairs and sets every weight to 1."""
    if binary:
        return prior.withColumn("w", F.lit(1.0))
    return prior.filter(F.col("w") >= least) if least > 0 else prior


def target_prior(raw: DataFrame, genes: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """(module, src, dst, w, source): the ``k`` strongest regulators of each target known to the module.

    ``raw`` has tf_module_column, gene_module_column and tf_target_score (with ``module`` if it differs by
    module); ``genes`` has module, gene and name.  Unknown genes, self pairs and scores <= 0 are dropped.
    ``strict`` fails on missing columns, otherwise an empty prior results.
    """
    needed = {"tf_module_column", "gene_module_column", "tf_target_score"}
    if not strict and not needed <= set(raw.columns):
        return raw.sparkSession.createDataFrame([], "module string, src int, dst int, w double, source string")
    require_columns(raw, needed, "directed prior")
    source = F.col("cell_activity_source") if "cell_activity_source" in raw.columns else F.lit(None).cast("string")
    on = ["module"] if "module" in raw.columns else []
    score = F.coalesce(F.expr("try_cast(tf_target_score as double)"), F.lit(0.0))
    listed = raw.select(
        *on, F.col("tf_module_column").cast("string").alias("_tf"), F.col("gene_module_column").cast("string").alias("_target"),
        score.alias("w"), source.alias("source"),
    ).filter("_tf <> _target and w > 0")
    known = lambda name, ident: genes.select("module", F.col("gene").alias(ident), F.col("name").alias(name))
    joined = listed.join(known("_tf", "src"), [*on, "_tf"]).join(known("_target", "dst"), ["module", "_target"])
    first = top_k(joined, ["module", "dst"], [F.desc("w"), F.asc("_tf"), F.asc_nulls_first("source")], k)
    return first.select("module", "src", "dst", "w", "source")


def prior_weights(prior: DataFrame) -> DataFrame:
    """Largest weight per (module, src, dst)."""
    return prior.groupBy("module", "src", "dst").agg(F.max("w").alias("w"))


def activity_weights(prior: DataFrame, expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(module, cell_id, src, dst, w): pair weight times the cell's zero-preserving rank of the pair's source gene.

    Several sources count by their largest profile; pairs without a source keep the weight in every cell.
    """
    named = genes.select("module", F.col("gene").alias("_source_gene"), F.col("name").alias("source"))
    sourced = prior.filter("trim(source) <> ''").withColumn("source", F.trim("source")).join(named, ["module", "source"])
    profile = zero_preserving_rank(expr, ["module", "gene"]).select(
        "module", "cell_id", F.col("gene").alias("_source_gene"), "profile")
    active = (
        sourced.select("module", "src", "dst", "_source_gene").join(profile, ["module", "_source_gene"])
        .groupBy("module", "cell_id", "src", "dst").agg(F.max("profile").alias("_activity"))
    )
    weights = prior_weights(prior)
    cells = expr.select("module", "cell_id").distinct()
    return (
        cells.join(weights, "module").join(active, ["module", "cell_id", "src", "dst"], "left")
        .select("module", "cell_id", "src", "dst", (F.col("w") * F.coalesce("_activity", F.lit(1.0))).alias("w"))
    )


def undirected_strength(weights: DataFrame) -> DataFrame:
    """Strongest direction per pair a < b."""
    key = [c for c in weights.columns if c not in ("src", "dst", "w")]
    return weights.groupBy(*key, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def raised_levels(base: float, motif: DataFrame | None, pair: DataFrame | None, *, motif_alpha: float = 0.20,
                  motif_min: float = 0.0, gamma: float = 1.0, cap: int = -1, pair_alpha: float = 0.20) -> DataFrame:
    """Raised significance rows (module, [cell_id], a, b, alpha, cap) from undirected strengths ``w``.

    Motif and pair evidence are listed separately because only the first is limited by the conditioning size.
    """
    rows = []
    for df, which, limit in ((motif, "motif", cap), (pair, "pair", -1)):
        if df is None:
            continue
        none = F.lit(0.0)
        strengths = (F.col("w"), none) if which == "motif" else (none, F.col("w"))
        level = effective_alpha(base, *strengths, motif_alpha=motif_alpha, pair_alpha=pair_alpha, motif_min=motif_min, gamma=gamma)
        key = [c for c in ("module", "cell_id") if c in df.columns]
        rows.append(df.select(*key, "a", "b", level.alias("alpha"), F.lit(limit).alias("cap")).filter(F.col("alpha") > base))
    if not rows:
        raise ValueError("no prior given")
    if len(rows) == 2 and "cell_id" in rows[0].columns and "cell_id" not in rows[1].columns:
        cells = motif.select("module", "cell_id").distinct()
        rows[1] = cells.join(rows[1], "module")
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def forbidden_pairs(genes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Gene pairs a < b of each module outside the allow list (which may be empty: then all pairs).

    Pairs of one module's genes, a size set by the module policy and not by the number of cells.
    """
    a = genes.select("module", F.col("gene").alias("a"))
    b = genes.select("module", F.col("gene").alias("b"))
    pairs = a.join(b, "module").filter("a < b")
    return pairs.join(allowed.select("module", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["module", "a", "b"], "left_anti")


def usable_links(links: DataFrame, genes: DataFrame) -> DataFrame:
    """Peak links fit for conditioning: passed, positively correlated, known gene, named peak; one row per peak.

    Adds ``weight``: peak_gene_weight, else peak_gene_corr, else 1, never negative.
    """
    require_columns(links, {"gene_module_column", "peak_name"}, "gene peak links")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    rows = links.withColumn("gene_module_column", F.col("gene_module_column").cast("string")) \
        .withColumn("peak_name", F.trim(F.col("peak_name").cast("string")))
    if "association_pass" in rows.columns:
        rows = rows.filter(F.coalesce(F.expr("try_cast(association_pass as boolean)"), F.lit(False)))
    corr: Column = F.lit(0.0)
    if "peak_gene_corr" in rows.columns:
        corr = number("peak_gene_corr")
        rows = rows.filter(corr > 0)
    weight = number("peak_gene_weight") if "peak_gene_weight" in rows.columns else (
        corr if "peak_gene_corr" in rows.columns else F.lit(1.0))
    known = genes.select("module", "gene", F.col("name").alias("gene_module_column"))
    on = [c for c in ("module", "gene_module_column") if c in rows.columns]
    return (
        rows.filter("peak_name <> ''").join(known, on)
        .select("module", "gene", "peak_name", corr.alias("_corr"), F.greatest(weight, F.lit(0.0)).alias("weight"))
        .groupBy("module", "gene", "peak_name")
        .agg(F.max_by("weight", F.struct("_corr", "weight")).alias("weight"))
    )


def gene_profiles(links: DataFrame, access: DataFrame, mode: str = "max", threshold: float = 0.0) -> DataFrame:
    """Second-modality value per (module, cell_id, gene): largest or weighted sum of its peaks' access.

    Values at or under a positive threshold become 0.  ``access`` is dense (peak_name, cell_id, access).
    """
    joined = links.join(access, "peak_name")
    combine = F.max("access") if mode == "max" else F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("access")).otherwise(F.lit(0.0)))
    value = F.col("value") if threshold <= 0 else F.when(F.col("value") <= threshold, F.lit(0.0)).otherwise(F.col("value"))
    return joined.groupBy("module", "cell_id", "gene").agg(combine.alias("value")).withColumn("value", value)
