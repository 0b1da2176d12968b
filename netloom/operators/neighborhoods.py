"""Rank-window neighbourhoods.

For key cell k and gene g the neighbourhood is the closed value range between the values found ``w``
positions below and above k's tie block, ``w`` being a truncated fraction of the cells.  A tie block longer
than ``w`` is its own neighbourhood, and if more than ``w`` (but not all) values are non-positive the window
does not reach down into them.  Equal values share one neighbourhood, so everything is worked out per tie
block and joined to cells last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .ranks import POSITIONS_PER_CHUNK, blocks_of_ties, counted_ties, join_ties

KEYS = ("module", "gene")


def tie_neighborhoods(
    expr: DataFrame, fraction: float = 0.1, group: Sequence[str] = KEYS, value: str = "value", floor_at: float = 0.0
) -> DataFrame:
    """One row per (group, value): value range ``lo``..``hi`` and the tie starts ``lo_start``..``hi_start`` of its ends."""
    return neighborhoods_of_ties(counted_ties(expr, group, value), fraction, group, value, floor_at)


def neighborhoods_of_ties(
    counted: DataFrame, fraction: float = 0.1, group: Sequence[str] = KEYS, value: str = "value", floor_at: float = 0.0
) -> DataFrame:
    """The same from distinct values and their sizes (group, value, tie_size)."""
    group = list(group)
    span = F.col("tie_start") + F.col("tie_size")
    width = F.floor(F.lit(float(fraction)) * F.col("n"))
    floor_pos = F.when((F.col("n_floor") > width) & (F.col("n_floor") < F.col("n")), F.col("n_floor")).otherwise(F.lit(0))
    asks = (
        blocks_of_ties(counted, group, value, floor_at)
        .withColumn("_w", width)
        .withColumn("_floor", floor_pos)
        .withColumn("_own", F.col("tie_size") > F.col("_w"))
        .withColumn(
            "_lo_at",
            F.when(F.col("_own"), F.col("tie_start")).otherwise(F.greatest("_floor", F.col("tie_start") - F.col("_w"))),
        )
        .withColumn(
            "_hi_at", F.when(F.col("_own"), F.col("tie_start")).otherwise(F.least(F.col("n") - 1, span - 1 + F.col("_w")))
        )
    )
    # Position 0, the first position above the floor and the last one are known per group, so the many rows
    # clamped to them need no lookup and cannot pile up on one position.
    def end(v, start):
        return F.struct(v.alias("v"), start.cast("long").alias("s"))

    def known(at):
        return (
            F.when(F.col("_own"), end(F.col(value), F.col("tie_start")))
            .when(at == 0, end(F.col("v_min"), F.lit(0)))
            .when(at == F.col("n") - 1, end(F.col("v_max"), F.col("v_max_start")))
            .when(at == F.col("n_floor"), end(F.col("v_floor"), F.col("n_floor")))
        )

    asks = asks.withColumn("_lo", known(F.col("_lo_at"))).withColumn("_hi", known(F.col("_hi_at")))
    chunk = F.lit(POSITIONS_PER_CHUNK)
    own = F.struct(F.col(value).alias("v"), F.col("tie_start").alias("s"))

    def entry(pos, side, answer):
        return F.struct(pos.cast("long").alias("pos"), F.lit(side).alias("side"), answer.alias("answer"))

    # A tie block answers from its first position (side 0), restated at each chunk border it spans.  Its own
    # questions stand at the positions asked for (sides 1 and 2), or at home if already answered.
    answers = F.transform(
        F.sequence(F.floor(F.col("tie_start") / chunk), F.floor((span - 1) / chunk)),
        lambda c: entry(F.greatest(c * chunk, F.col("tie_start")), 0, own),
    )
    asked = [
        entry(F.when(F.col(ready).isNull(), F.col(at)).otherwise(F.col("tie_start")), side, F.col(ready))
        for at, side, ready in (("_lo_at", 1, "_lo"), ("_hi_at", 2, "_hi"))
    ]
    stream = asks.select(
        *group,
        F.col(value).alias("_v"),
        F.struct("tie_start", "tie_size", "n", "n_floor").alias("_p"),
        F.explode(F.concat(answers, F.array(*asked))).alias("_e"),
    ).withColumn("_block", F.floor(F.col("_e.pos") / chunk))
    seen = W.partitionBy(*group, "_block").orderBy("_e.pos", "_e.side")
    found = (
        stream.withColumn("_last", F.last(F.when(F.col("_e.side") == 0, F.col("_e.answer")), ignorenulls=True).over(seen))
        .filter(F.col("_e.side") > 0)
        .select(*group, "_v", "_p", F.col("_e.side").alias("_side"), F.coalesce("_e.answer", "_last").alias("_answer"))
    )
    return (
        found.groupBy(*group, F.col("_v").alias(value))
        .agg(
            F.first("_p").alias("_p"),
            F.max(F.when(F.col("_side") == 1, F.col("_answer"))).alias("_lo"),
            F.max(F.when(F.col("_side") == 2, F.col("_answer"))).alias("_hi"),
        )
        .select(
            *group,
            value,
            F.col("_p.tie_start").alias("tie_start"),
            F.col("_p.tie_size").alias("tie_size"),
            F.col("_p.n").alias("n"),
            F.col("_p.n_floor").alias("n_floor"),
            F.col("_lo.v").alias("lo"),
            F.col("_hi.v").alias("hi"),
            F.col("_lo.s").alias("lo_start"),
            F.col("_hi.s").alias("hi_start"),
        )
    )


def cell_neighborhoods(expr: DataFrame, fraction: float = 0.1, floor_at: float = 0.0) -> DataFrame:
    """Neighbourhood range of every (module, cell, gene)."""
    return join_ties(expr, tie_neighborhoods(expr, fraction, KEYS, "value", floor_at), KEYS)


def neighborhood_sizes(expr: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Members per (module, cell, gene) without listing them: positions covered by the range, 0 if inverted."""
    ties = tie_neighborhoods(expr, fraction)
    ends = ties.select(*KEYS, F.col("tie_start").alias("hi_start"), F.col("tie_size").alias("_end_size"))
    sized = ties.join(ends, [*KEYS, "hi_start"]).withColumn(
        "members", F.greatest(F.lit(0), F.col("hi_start") + F.col("_end_size") - F.col("lo_start"))
    )
    return join_ties(expr, sized.select(*KEYS, "value", "tie_size", "members"), KEYS).drop("tie_size")
