"""Ranking that never puts a whole group into one window partition.

Every rank statistic is a running count over the distinct values of a group.  The count is split in two:
inside a value chunk (one window partition per chunk) and over the chunk totals (a few thousand rows per
group).  Equal values are aggregated before the first shuffle, so a value held by a third of all rows is
one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNKS_PER_UNIT = 16384
VALUES_PER_CHUNK = 4096
POSITIONS_PER_CHUNK = 65536
HOT_ROWS, HOT_BLOCKS, SALTS = 65536, 4096, 64


def value_chunk(value: Column) -> Column:
    """Monotone bucket of a number: absolute steps near zero, relative steps further out.

    log1p is semi-monotonic on the JVM, so ordering by (chunk, value) equals ordering by value.  NaN comes last.
    """
    bucket = F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(CHUNKS_PER_UNIT))).cast("long")
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(bucket)


def with_chunks(ties: DataFrame, group: Sequence[str], value: str, out: str = "_chunk") -> DataFrame:
    """Add a chunk that is monotone in ``value`` and holds few distinct values, wherever the values lie.

    A bucket of ``value_chunk`` with more than ``VALUES_PER_CHUNK`` distinct values is cut evenly between its ends.
    The list of such buckets is that factor shorter than the values.
    """
    group = list(group)
    v = F.col(value)
    ties = ties.withColumn("_bucket", value_chunk(v))
    crowded = (
        ties.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_held"), F.min(v).alias("_least"), F.max(v).alias("_most"))
        .filter(F.col("_held") > VALUES_PER_CHUNK)
    )
    parts = F.ceil(F.col("_held") / F.lit(VALUES_PER_CHUNK))
    part = F.floor((v - F.col("_least")) / (F.col("_most") - F.col("_least")) * parts)
    return ties.join(crowded, [*group, "_bucket"], "left").withColumn(
        out, F.struct("_bucket", F.coalesce(part, F.lit(0)).alias("part"))).drop("_bucket", "_held", "_least", "_most")


def join_ties(df: DataFrame, ties: DataFrame, group: Sequence[str], value: str = "value", how: str = "inner") -> DataFrame:
    """Give every row of ``df`` the columns of its tie block, without moving a hot block's rows to one task.

    The keys of the ``HOT_BLOCKS`` largest blocks are known to both sides, which spread them over ``SALTS`` copies;
    any other block holds less than one row in ``HOT_BLOCKS``.
    """
    key = [*group, value]
    added = [c for c in ties.columns if c not in key]
    # The order is total, so both uses of the list agree however often it is worked out.
    hot = (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("tie_size")).filter(F.col("tie_size") > HOT_ROWS)
        .orderBy(F.desc("tie_size"), *key).limit(HOT_BLOCKS).select(*key, F.lit(True).alias("_hot"))
    )
    marked = lambda side: side.join(F.broadcast(hot), key, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answers = marked(ties).withColumn("_salt", F.explode(copies)).drop("_hot")
    return marked(df).withColumn("_salt", salt).join(answers, [*key, "_salt"], how).select(*df.columns, *added)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    weight: Column,
    out: str,
) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over the rows strictly before each row, group by group.

    ``chunk`` must be monotone in ``order``.  Only chunk totals are ever gathered per group.
    """
    group = list(group)
    inside = W.partitionBy(*group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*group, chunk)
        .agg(F.sum(weight).alias("_chunk_total"))
        .withColumn("_base", F.coalesce(F.sum("_chunk_total").over(before), F.lit(0)))
        .drop("_chunk_total")
    )
    local = df.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        local.join(totals.hint("merge"), [*group, chunk])
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def tie_blocks(df: DataFrame, group: Sequence[str], value: str = "value", floor_at: float = 0.0) -> DataFrame:
    """One row per distinct value: start position, size, and the totals of its group.

    Columns added: ``tie_start`` (values below), ``tie_size``, ``n`` (group size), ``n_floor`` (values at or
    under ``floor_at``), ``v_min``, ``v_max`` with its start ``v_max_start``, and ``v_floor`` (least value above ``floor_at``).
    """
    return blocks_of_ties(counted_ties(df, group, value), group, value, floor_at)


def counted_ties(df: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """(group, value, tie_size): how many rows hold each distinct value."""
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("tie_size"))


def blocks_of_ties(counted: DataFrame, group: Sequence[str], value: str = "value", floor_at: float = 0.0) -> DataFrame:
    """The columns of ``tie_blocks`` from distinct values and their sizes, wherever these come from."""
    group = list(group)
    v = F.col(value)
    ties = with_chunks(counted, group, value)
    over_chunks = W.partitionBy(*group)
    before = over_chunks.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ties.groupBy(*group, "_chunk")
        .agg(
            F.sum("tie_size").alias("_rows"),
            F.sum(F.when(v <= floor_at, F.col("tie_size")).otherwise(F.lit(0))).alias("_floor_rows"),
            F.min(v).alias("_min"),
            F.max(F.struct(v.alias("v"), F.col("tie_size").alias("size"))).alias("_max"),
            F.min(F.when(v > floor_at, v)).alias("_above"),
        )
        .select(
            *group,
            "_chunk",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
            F.sum("_rows").over(over_chunks).alias("n"),
            F.sum("_floor_rows").over(over_chunks).alias("n_floor"),
            F.min("_min").over(over_chunks).alias("v_min"),
            F.max("_max").over(over_chunks).alias("_top"),
            F.min("_above").over(over_chunks).alias("v_floor"),
        )
    )
    inside = W.partitionBy(*group, "_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        ties.withColumn("_inside", F.coalesce(F.sum("tie_size").over(inside), F.lit(0)))
        .join(totals.hint("merge"), [*group, "_chunk"])
        .withColumn("tie_start", F.col("_base") + F.col("_inside"))
        .withColumn("v_max", F.col("_top.v"))
        .withColumn("v_max_start", F.col("n") - F.col("_top.size"))
        .drop("_base", "_inside", "_chunk", "_top")
    )


def quantile(df: DataFrame, group: Sequence[str], q: float, value: str = "value", out: str = "quantile") -> DataFrame:
    """Exact linearly interpolated quantile per group, read off the tie blocks instead of a per-group buffer."""
    return quantile_of_ties(counted_ties(df.filter(F.col(value).isNotNull()), group, value), group, q, value, out)


def quantile_of_ties(counted: DataFrame, group: Sequence[str], q: float, value: str = "value", out: str = "quantile") -> DataFrame:
    """The same from distinct values and their sizes."""
    group = list(group)
    at = F.lit(float(q)) * (F.col("n") - 1)
    below, above = F.floor(at), F.ceil(at)
    covers = lambda p: (F.col("tie_start") <= p) & (p < F.col("tie_start") + F.col("tie_size"))
    ends = blocks_of_ties(counted, group, value).groupBy(*group).agg(
        F.max(F.when(covers(below), F.col(value))).alias("_lo"),
        F.max(F.when(covers(above), F.col(value))).alias("_hi"),
        F.max(at - below).alias("_part"),
    )
    return ends.select(*group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def average_rank(df: DataFrame, group: Sequence[str], value: str = "value", out: str = "avg_rank") -> DataFrame:
    """Mean rank of ties, 1-based."""
    ranks = tie_blocks(df, group, value).select(
        *group, value, "tie_size", (F.col("tie_start") + (F.col("tie_size") + 1) / F.lit(2.0)).alias(out)
    )
    return join_ties(df, ranks, group, value).drop("tie_size")


def ordinal_position(
    df: DataFrame, group: Sequence[str], value: str = "value", tie_by: str = "cell_id", out: str = "position"
) -> DataFrame:
    """Zero-based position by (value, ``tie_by``); also carries the tie block columns."""
    group = list(group)
    placed = join_ties(df, tie_blocks(df, group, value), group, value)
    placed = placed.withColumn("_slice", F.floor(F.col(tie_by) / F.lit(POSITIONS_PER_CHUNK)).cast("long"))
    placed = running_total(placed, [*group, value], "_slice", [F.col(tie_by)], F.lit(1), "_offset")
    return placed.withColumn(out, F.col("tie_start") + F.col("_offset")).drop("_slice", "_offset")


def zero_preserving_rank(df: DataFrame, group: Sequence[str], value: str = "value", out: str = "profile") -> DataFrame:
    """Average rank among positive values over their number; everything else is 0."""
    group = list(group)
    positive = df.filter((F.col(value) > 0) & ~F.isnan(value))
    ranks = tie_blocks(positive, group, value).select(
        *group,
        value,
        "tie_size",
        ((F.col("tie_start") + (F.col("tie_size") + 1) / F.lit(2.0)) / F.col("n")).alias(out),
    )
    rest = (F.col(value) > 0) & ~F.isnan(value)
    asked = df.withColumn("_asked", F.when(rest, F.col(value)).otherwise(-1.0 - F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))))
    return join_ties(asked, ranks.withColumnRenamed(value, "_asked"), group, "_asked", "left").drop("_asked", "tie_size").withColumn(out, F.coalesce(out, F.lit(0.0)))


def ordinal_rank_scale(df: DataFrame, group: Sequence[str], value: str = "value", tie_by: str = "cell_id",
                       out: str = "scaled") -> DataFrame:
    """1 + position / (n - 1); a single row scales to 1."""
    placed = ordinal_position(df, group, value, tie_by, "_position")
    scaled = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(1.0 + F.col("_position") / (F.col("n") - 1))
    return placed.withColumn(out, scaled).select(*df.columns, out)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    A hot group is first cut to ``k`` rows in each of many random-free salts (hash of the row), so no task
    ever sorts the whole group.
    """
    group = list(group)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    first = W.partitionBy(*group, "_salt").orderBy(*order)
    last = W.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(first))
        .filter(F.col(rank) <= k)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= k)
    )


def group_stats(df: DataFrame, group: Sequence[str], *aggs: Column) -> DataFrame:
    """Join aggregates back to every row: map-side combined, so a hot group costs one row per task."""
    return df.join(df.groupBy(*group).agg(*aggs), list(group))
