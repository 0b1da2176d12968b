"""Scaling of counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import group_stats, quantile

# Library size target, smallest usable spread.
TARGET = 1e4
TINY = 1e-8


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("count").alias("total"))


def log_normalize(counts: DataFrame, value: str = "count", cell: list[str] | None = None) -> DataFrame:
    """log1p of counts scaled to 10,000 per cell; an empty cell stays 0."""
    sized = group_stats(counts, cell or ["cell_id"], F.sum(value).alias("total"))
    scaled = F.when(F.col("total") > 0, F.col(value) * (F.lit(TARGET) / F.col("total"))).otherwise(F.lit(0.0))
    return sized.withColumn("value", F.log1p(scaled))


def count_likeness(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: share of near-integers among finite values, their maximum, and the resulting mode."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    near = F.abs(v - F.round(v)) <= 1e-8 + 1e-5 * F.abs(F.round(v))
    facts = values.filter(finite).agg(F.avg(near.cast("double")).alias("integer_share"), F.max(v).alias("top"))
    mode = (
        F.when(F.col("top").isNull(), F.lit("empty"))
        .when((F.col("integer_share") > 0.95) & (F.col("top") > 20), F.lit("counts_to_log1p"))
        .otherwise(F.lit("already_log_like"))
    )
    return facts.withColumn("mode", mode)


def auto_log(values: DataFrame) -> tuple[DataFrame, str]:
    """Log-normalise a dense long matrix if it looks like counts; returns the frame and what was done."""
    mode = count_likeness(values).first()["mode"]
    if mode != "counts_to_log1p":
        return values, mode
    key = [c for c in ("module", "cell_id") if c in values.columns]
    logged = log_normalize(values.withColumnRenamed("value", "_raw"), "_raw", key)
    return logged.drop("_raw", "total"), mode


def open_scale(access: DataFrame, peak: str = "peak", value: str = "count") -> DataFrame:
    """log1p scaled by the 95th percentile of a peak's positive values, clipped to [0, 1]."""
    high = quantile(access.filter(F.col(value) > 0), [peak], 0.95, value, "p95")
    scaled = access.join(high, peak, "left")
    share = F.log1p(F.col(value)) / F.log1p("p95")
    return scaled.withColumn(
        "access", F.when(F.col("p95") > 0, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    )


def min_max(df: DataFrame, group: list[str], value: str, out: str, fill: float = 1.0) -> DataFrame:
    """(v - min) / (max - min) over finite values; constant groups give ``fill``, other non-finite values 0."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ends = (F.min(F.when(finite, v)).alias("_lo"), F.max(F.when(finite, v)).alias("_hi"))
    if group:
        ranged = group_stats(df, group, *ends)
    else:
        whole = df.agg(F.struct(*ends).alias("_ends"))
        ranged = df.withColumn("_ends", whole.scalar()).select(*df.columns, "_ends.*")
    scaled = (
        F.when(F.col("_lo").isNull(), F.lit(float(fill)))
        .when(~finite, F.lit(0.0))
        .when(F.col("_hi") - F.col("_lo") <= TINY, F.lit(float(fill)))
        .otherwise((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    )
    return ranged.withColumn(out, scaled).drop("_lo", "_hi")


def keep_threshold(df: DataFrame, group: list[str], value: str, keep: float) -> DataFrame:
    """Value at quantile 1 - ``keep`` per group; a group without rows has none, so nothing passes it."""
    q = max(0.0, min(1.0, 1.0 - keep))
    return quantile(df, group, q, value, "threshold")


def binarize(counts: DataFrame, value: str = "count") -> DataFrame:
    """Stored entries become 1, explicit zeros included."""
    return counts.withColumn(value, F.lit(1.0))


def floor_profile(profile: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Values at or under a positive threshold become 0."""
    if threshold <= 0:
        return profile
    return profile.withColumn(value, F.when(F.col(value) <= threshold, F.lit(0.0)).otherwise(F.col(value)))


def tf_idf(counts: DataFrame, n_cells: Column | int, cell: str = "cell_id", feature: str = "feature_id") -> DataFrame:
    """Binary term share per cell times log1p(cells / cells with the feature)."""
    sized = group_stats(counts, [cell], F.count(F.lit(1)).alias("_len"))
    spread = group_stats(sized, [feature], F.count(F.lit(1)).alias("_df"))
    cells = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    weight = (F.lit(1.0) / F.col("_len")) * F.log1p(cells / F.greatest(F.col("_df"), F.lit(1)))
    return spread.withColumn("weight", weight).drop("_len", "_df")
