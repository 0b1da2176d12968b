"""Feature and cell selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .ranks import POSITIONS_PER_CHUNK, running_total


def of_type(counts: DataFrame, features: DataFrame, feature_type: str) -> DataFrame:
    """Counts of one feature type."""
    wanted = features.filter(F.col("feature_type") == feature_type).select("feature_id")
    return counts.join(wanted, "feature_id", "left_semi")


def feature_stats(counts: DataFrame, n_cells: int, value: str = "count", feature: str = "feature_id") -> DataFrame:
    """Detected cells, mean and population variance with absent cells counted as zeros."""
    v = F.col(value).cast("double")
    return (
        counts.groupBy(feature)
        .agg(F.sum((v > 0).cast("long")).alias("detected"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
        .select(
            feature, "detected", (F.col("_s") / n_cells).alias("mean"),
            (F.col("_q") / n_cells - (F.col("_s") / n_cells) * (F.col("_s") / n_cells)).alias("variance"),
        )
    )


def top_variable(counts: DataFrame, n_cells: int, top: int, min_cells: int, value: str = "count",
                 feature: str = "feature_id") -> DataFrame:
    """The most variable features seen in at least ``min_cells`` cells; ties go to the higher id."""
    passed = feature_stats(counts, n_cells, value, feature).filter(F.col("detected") >= min_cells)
    return passed.orderBy(F.desc("variance"), F.desc(feature)).limit(top)


def require_features(selected: DataFrame) -> DataFrame:
    if selected.isEmpty():
        raise ValueError("no feature passed the min_cells filter")
    return selected


def top_cells(scores: DataFrame, top: int | None, score: str = "total", cell: str = "cell_id") -> DataFrame:
    """Best-scoring cells; all of them when ``top`` is None."""
    return scores if top is None else scores.orderBy(F.desc(score), F.desc(cell)).limit(top)


def unique_names(features: DataFrame, name: str = "name", ident: str = "feature_id", order: str = "ordinal",
                 out: str = "unique_name") -> DataFrame:
    """The first bearer keeps a name, later ones become ``name|id``."""
    firsts = features.groupBy(name).agg(F.min(order).alias("_first"))
    return features.join(firsts, name).withColumn(
        out, F.when(F.col(order) == F.col("_first"), F.col(name)).otherwise(F.concat_ws("|", name, ident))
    ).drop("_first")


def order_in_group(df: DataFrame, group: list[str], order: str, out: str = "order_in_module") -> DataFrame:
    """1-based place by an integer column, counted in slices of it."""
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(POSITIONS_PER_CHUNK)).cast("long"))
    placed = running_total(sliced, group, "_slice", [F.col(order)], F.lit(1), out)
    return placed.withColumn(out, (F.col(out) + 1).cast("long")).drop("_slice")


def variance_windows(stats: DataFrame, size: int = 6, stride: int = 4, gene: str = "gene") -> DataFrame:
    """Overlapping windows over genes ranked by variance, with a last window flush to the end.

    (group_id, gene) rows.  Genes are columns of a matrix, so ranking them in one window is bounded.
    """
    ranked = stats.select(gene, F.row_number().over(W.orderBy(F.desc("variance"), F.desc(gene))).alias("_r"),
                          F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    width = F.least(F.lit(size), F.col("_n"))
    last = F.col("_n") - width
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    windows = ranked.select(gene, (F.col("_r") - 1).alias("_r"), F.posexplode(starts).alias("group_id", "_s"), width.alias("_w"))
    return windows.filter((F.col("_r") >= F.col("_s")) & (F.col("_r") < F.col("_s") + F.col("_w"))).select("group_id", gene)


def modules_to_labels(features: DataFrame, membership: DataFrame, gene: str = "gene") -> DataFrame:
    """Module number per gene, -1 outside all modules."""
    return features.join(membership.select(gene, "module_no"), gene, "left").withColumn(
        "label", F.coalesce("module_no", F.lit(-1)).cast("int")
    ).drop("module_no")


def module_summary(membership: DataFrame, module: str = "module") -> DataFrame:
    """Number and sizes of modules and the pairs they hold."""
    size = F.col("size")
    sizes = membership.groupBy(module).agg(F.count(F.lit(1)).alias("size"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return sizes.agg(
        F.count(F.lit(1)).alias("module_count"),
        zero(F.min(size), "long").alias("min_size"),
        zero(F.median(size), "double").alias("median_size"),
        zero(F.max(size), "long").alias("max_size"),
        zero(F.sum(F.floor(size * (size - 1) / 2)), "long").alias("pairwise_load"),
    )
