"""Average linkage in rounds over a table of cluster pairs.

Average linkage is reducible: a merge never brings a cluster nearer to a third one than its nearest part was.  So all
pairs of clusters that are each other's nearest can merge in the same round, and the merges are those of the sequential
rule, lowest distance first and of equal distances the lowest pair.  A cluster is named by its first member.  The table
holds one row per pair with the sum of the distances between members, as a whole number, so sums do not depend on the
order in which tasks deliver them.  A cluster whose nearest one lies beyond the cut can never merge and leaves the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written

UNIT = float(1 << 32)  # a distance of 1 as a whole number; sums over 2^30 pairs stay below 2^63
HELD_ROUNDS = 24


def linkage(pairs: DataFrame, cut: float | None = None) -> DataFrame:
    """(set, child, parent, height) of the merges up to ``cut`` (all without one), from (set, a, b, distance), a < b.

    A child is absorbed once; along the path to the last parent heights do not fall.  No pairs, no merges.
    """
    one = F.lit(1).cast("long")
    state = written(pairs.select("set", "a", "b", one.alias("na"), one.alias("nb"),
                                     F.round(F.col("distance") * UNIT).cast("long").alias("total")))
    done: list[DataFrame] = []
    while True:
        near = written(_nearest(state, cut))
        joined = near.groupBy("set", "a", "b", "height").agg(F.count(F.lit(1)).alias("ends"), F.sum("n").alias("size")).filter("ends = 2")
        if joined.isEmpty():
            break
        done.append(joined.select("set", F.col("b").alias("child"), F.col("a").alias("parent"), "height"))
        state = written(_advance(state, near, joined))
        if len(done) == HELD_ROUNDS:
            done = [written(_union(done))]
    if not done:
        return near.limit(0).select("set", F.col("b").alias("child"), F.col("a").alias("parent"), "height")
    return written(_union(done))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nearest(state: DataFrame, cut: float | None) -> DataFrame:
    """(set, x, n, height, a, b): the nearest pair of each cluster x of n members, if within the cut."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("na").alias("n")), F.struct(F.col("b").alias("x"), F.col("nb").alias("n"))))
    height = F.col("total") / F.lit(UNIT) / (F.col("na") * F.col("nb"))
    best = state.withColumn("height", height).select("set", "height", "a", "b", ends).groupBy("set", "x").agg(
        F.min(F.struct("height", "a", "b")).alias("pair"), F.first("n").alias("n")).select("set", "x", "n", "pair.*")
    return best if cut is None else best.filter(F.col("height") <= F.lit(cut))


def _advance(state: DataFrame, near: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs between the clusters after the merges; clusters that ``near`` lacks are finished."""
    fate = near.join(joined.select("set", "a", "b", "size"), ["set", "a", "b"], "left").select(
        "set", "x", F.when(F.col("size").isNotNull(), F.col("a")).otherwise(F.col("x")).alias("to"), F.coalesce("size", "n").alias("size"))
    side = lambda s: fate.select("set", F.col("x").alias(s), F.struct("to", "size").alias(f"to_{s}"))
    ends = F.array_sort(F.array("to_a", "to_b"))
    return (
        state.select("set", "a", "b", "total").join(side("a"), ["set", "a"]).join(side("b"), ["set", "b"])
        .filter("to_a.to <> to_b.to").select("set", ends.alias("e"), "total")
        .groupBy("set", "e").agg(F.sum("total").alias("total"))
        .select("set", F.col("e")[0]["to"].alias("a"), F.col("e")[1]["to"].alias("b"),
                F.col("e")[0]["size"].alias("na"), F.col("e")[1]["size"].alias("nb"), "total")
    )


def roots(merges: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """``members`` (set, ``member``, ...) with ``root``, the cluster each ends in; paths are halved until all are short."""
    hops = written(merges.select("set", "child", "parent"))
    while True:
        onward = hops.select("set", F.col("child").alias("parent"), F.col("parent").alias("next"))
        longer = hops.join(onward, ["set", "parent"], "left")
        if longer.filter("next is not null").isEmpty():
            break
        hops = written(longer.select("set", "child", F.coalesce("next", "parent").alias("parent")))
    return members.join(hops.withColumnRenamed("child", member), ["set", member], "left").withColumn(
        "root", F.coalesce("parent", F.col(member))).drop("parent")
