"""Rank statistics of sparse matrices: what is not stored is a zero, and the zeros of a feature are one tie block.

Entries are (feature, cell_id, value); ``listed`` names the features, so one without entries counts as all zero, and ``n_cells``
is the number of cells, or the name of the column of ``listed`` that holds it. The size of a feature's zero block is ``n_cells`` less its stored non-zero entries. With that one further
row per feature, ranks, quantiles and neighbourhoods come from the same tie tables as dense data, and no zero is ever a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .correlation import TINY
from .neighborhoods import neighborhoods_of_ties
from .ranks import blocks_of_ties, counted_ties, join_ties, quantile_of_ties


def stored(entries: DataFrame, value: str = "value") -> DataFrame:
    """The non-zero entries; a stored zero or null is as good as none."""
    return entries.filter(F.col(value).isNotNull() & (F.col(value) != 0))


def _count(n_cells: Column | int | str) -> Column:
    return F.lit(n_cells) if isinstance(n_cells, int) else F.col(n_cells) if isinstance(n_cells, str) else n_cells


def zero_filled_ties(entries: DataFrame, listed: DataFrame, group: Sequence[str], n_cells: Column | int | str, value: str = "value") -> DataFrame:
    """(group, value, tie_size) with the zero block; features without entries are one block."""
    group = list(group)
    counted = counted_ties(stored(entries, value), group, value)
    held = counted.groupBy(*group).agg(F.sum("tie_size").alias("_held"))
    own = [n_cells] if isinstance(n_cells, str) else []
    zeros = listed.select(*group, *own).distinct().join(held, group, "left").select(
        *group, F.lit(0.0).alias(value), (_count(n_cells) - F.coalesce("_held", F.lit(0))).cast("bigint").alias("tie_size"))
    return counted.unionByName(zeros.filter("tie_size > 0"))


def zero_filled_quantile(entries: DataFrame, listed: DataFrame, group: Sequence[str], n_cells: Column | int | str, q: float,
                         value: str = "value", out: str = "quantile") -> DataFrame:
    """Exact interpolated quantile over all cells."""
    return quantile_of_ties(zero_filled_ties(entries, listed, group, n_cells, value), group, q, value, out)


def centred_ranks(entries: DataFrame, listed: DataFrame, group: Sequence[str], n_cells: Column | int | str, value: str = "value",
                  out: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Average ranks over all cells, moved so that zero ranks 0: (stored rows, facts of each feature).

    Facts are ``zero_rank`` (what was taken off, the middle of the zero block or of the place it would have), ``mean`` and
    ``spread`` (sum of squared deviations) over all cells; they come from the tie table alone.
    """
    group = list(group)
    blocks = cut_lineage(blocks_of_ties(zero_filled_ties(entries, listed, group, n_cells, value), group, value))  # read for facts and ranks
    below = F.sum(F.when(F.col(value) < 0, F.col("tie_size")).otherwise(F.lit(0)))
    zeros = F.sum(F.when(F.col(value) == 0, F.col("tie_size")).otherwise(F.lit(0)))
    rank = F.col("tie_start") + (F.col("tie_size") + 1) / F.lit(2.0)
    mean = (F.max("n") + 1) / F.lit(2.0)
    facts = blocks.groupBy(*group).agg(
        (below + (zeros + 1) / F.lit(2.0)).alias("zero_rank"), mean.alias("_mean"), F.max("n").alias("n"),
        (F.sum(F.col("tie_size") * rank * rank) - F.max("n") * mean * mean).alias("spread"),
    ).select(*group, "zero_rank", (F.col("_mean") - F.col("zero_rank")).alias("mean"), "spread", "n")
    facts = cut_lineage(facts)
    ranks = blocks.filter(F.col(value) != 0).join(facts.select(*group, "zero_rank"), group).select(
        *group, value, "tie_size", (rank - F.col("zero_rank")).alias(out))
    return join_ties(stored(entries, value), ranks, group, value).drop("tie_size"), facts


def sparse_rank_correlations(pairs: DataFrame, left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], n_cells: Column | int) -> DataFrame:
    """Spearman (left_id, right_id, corr) of listed pairs; 0 where either side is constant.

    ``left`` and ``right`` are ``centred_ranks`` of (left_id / right_id, cell_id, rank). Ranks are 0 in cells without an entry,
    so a product needs the cells in which both features have one; the rest follows from the facts.
    """
    (l_rows, l_facts), (r_rows, r_facts) = left, right
    asked = pairs.select("left_id", "right_id").distinct()
    products = (
        asked.join(l_rows.select("left_id", "cell_id", F.col("rank").alias("_l")), "left_id")
        .join(r_rows.select("right_id", "cell_id", F.col("rank").alias("_r")), ["right_id", "cell_id"])
        .groupBy("left_id", "right_id").agg(F.sum(F.col("_l") * F.col("_r")).alias("_xy"))
    )
    facts = lambda df, name: df.select(f"{name}_id", F.col("mean").alias(f"_{name}_mean"), F.col("spread").alias(f"_{name}_spread"))
    joined = asked.join(products, ["left_id", "right_id"], "left").join(facts(l_facts, "left"), "left_id", "left").join(facts(r_facts, "right"), "right_id", "left")
    scale = F.sqrt(F.col("_left_spread") * F.col("_right_spread"))
    corr = (F.coalesce("_xy", F.lit(0.0)) - _count(n_cells) * F.col("_left_mean") * F.col("_right_mean")) / scale
    return joined.select("left_id", "right_id", F.when(scale > TINY, corr).otherwise(F.lit(0.0)).alias("corr"))


def sparse_neighborhoods(entries: DataFrame, listed: DataFrame, n_cells: Column | int | str, fraction: float, floor_at: float = 0.0,
                         group: Sequence[str] = ("module", "gene")) -> tuple[DataFrame, DataFrame]:
    """Rank-window neighbourhoods of the stored entries, and the one that all zeros of a feature share (no row where there is none)."""
    group = list(group)
    ties = cut_lineage(neighborhoods_of_ties(zero_filled_ties(entries, listed, group, n_cells), fraction, group, "value", floor_at))
    return join_ties(stored(entries), ties.filter("value <> 0"), group), ties.filter("value = 0")
