"""Gene modules: average-linkage clusters of topological overlap under a size policy, and their pair priors.

Everything a module decision needs is in the genes x genes covariance: correlation, overlap of any subset, variances and
the correlation of module centroids.  It stays a table of pairs.  Too large clusters are all cut again at the same time,
level by level, each level by rounds over cluster pairs; no gene count is refused and no dataset is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import support_label
from ..session import written
from .correlation import adjacency, correlations, dense_vectors, gram, topological_overlap
from .features import order_in_group
from .linkage import linkage, roots
from .normalize import keep_threshold
from .ranks import group_stats

# Deepest cut, its step, smallest usable norms, kept shares of pairs.
LEAST_CUT, CUT_STEP = 0.35, 0.05
TINY = 1e-8
STRONG_SHARE, AMBIGUOUS_SHARE, PROMOTER_SHARE = 0.03, 0.15, 0.20
FETCHED, HELD = 32, 256  # rows of small clusters fetched at once, and held


def covariances(expr: DataFrame, n_genes: int) -> DataFrame:
    """(module, i, j, cov) for i <= j as sums of centred products."""
    centred = group_stats(expr, ["module", "gene"], F.avg("value").alias("_m")).withColumn("_c", F.col("value") - F.col("_m"))
    return gram(dense_vectors(centred, "cell_id", "gene", "_c", n_genes), n_genes).withColumnRenamed("product", "cov")


def sparse_covariances(expr: DataFrame, n_genes: int, n_cells: int) -> DataFrame:
    """The same over ``n_cells`` cells where ``expr`` leaves out zeros: products of stored entries less those of the means."""
    product = gram(dense_vectors(expr, "cell_id", "gene", "value", n_genes), n_genes)
    sums = expr.groupBy("module", "gene").agg(F.sum("value").alias("_s"))
    side = lambda g: sums.select("module", F.col("gene").alias(g), F.col("_s").alias(f"_{g}"))
    joined = product.join(side("i"), ["module", "i"], "left").join(side("j"), ["module", "j"], "left")
    taken = F.coalesce(F.col("_i") * F.col("_j") / F.lit(float(n_cells)), F.lit(0.0))
    return joined.select("module", "i", "j", (F.col("product") - taken).alias("cov"))


def gene_correlations(cov: DataFrame) -> DataFrame:
    """(module, i, j, corr) for i <= j from covariances; genes that do not vary correlate 0 with others."""
    norm = cov.filter("i = j").select("module", F.col("i").alias("g"), F.sqrt("cov").alias("s"))
    side = lambda g: norm.select("module", F.col("g").alias(g), F.when(F.col("s") > TINY, F.col("s")).otherwise(F.lit(1.0)).alias(f"_{g}"))
    ratio = F.col("cov") / F.col("_i") / F.col("_j")
    clipped = F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))
    return cov.join(side("i"), ["module", "i"]).join(side("j"), ["module", "j"]).select(
        "module", "i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(clipped).alias("corr"))


def _distances(corr: DataFrame, parts: DataFrame, power: float) -> DataFrame:
    """(set, a, b, distance) between the genes of each set, by the overlap within it; a, b are genes, a < b."""
    placed = written(order_in_group(parts, ["set"], "gene", "place").withColumn("place", (F.col("place") - 1).cast("int")))
    width = placed.agg(F.max("place")).first()[0] + 1
    side = lambda g: placed.select("dataset", "set", F.col("gene").alias(g), F.col("place").alias(f"_{g}"))
    inside = corr.withColumnRenamed("module", "dataset").join(side("i"), ["dataset", "i"]).join(side("j"), ["dataset", "set", "j"])
    local = inside.select(F.col("set").alias("module"), F.col("_i").alias("i"), F.col("_j").alias("j"), "corr")
    overlap = topological_overlap(adjacency(local, power), width).filter("i < j").withColumnRenamed("module", "set")
    name = lambda p, g: placed.select("set", F.col("place").alias(p), F.col("gene").alias(g))
    distance = F.least(F.greatest(F.lit(1.0) - F.col("tom"), F.lit(0.0)), F.lit(2.0))
    return overlap.join(name("i", "a"), ["set", "i"]).join(name("j", "b"), ["set", "j"]).select("set", "a", "b", distance.alias("distance"))


def _renamed(labelled: DataFrame, label: str) -> DataFrame:
    """(dataset, set, gene): a set for each label, named by its dataset and first gene."""
    first = F.min("gene").over(W.partitionBy("set", label))
    return labelled.select("dataset", F.concat_ws("/", "dataset", first).alias("set"), "gene")


def _forced(distances: DataFrame, whole: DataFrame, variance: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """Sets that no cut divides: the fewest merges that leave ceil(size / largest) clusters; where equal heights leave
    one cluster, pieces of ``largest`` genes by falling variance.  Returns (parts to look at again, final pieces)."""
    need = whole.groupBy("set").agg(F.count(F.lit(1)).alias("size")).withColumn("take", F.col("size") - F.ceil(F.col("size") / F.lit(largest)))
    merges = linkage(distances.join(need.select("set"), "set", "left_semi"))
    # One row per gene and set at most, so this order is as wide as a matrix has genes.
    ranked = merges.withColumn("_k", F.row_number().over(W.partitionBy("set").orderBy("height")))
    limit = ranked.join(need, "set").filter("_k = take").select("set", F.col("height").alias("limit"))
    labelled = written(roots(merges.join(limit, "set").filter("height <= limit"), whole, "gene"))
    single = labelled.groupBy("set").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("set")
    cut_up = labelled.join(single, "set", "left_semi").join(variance, ["dataset", "gene"])
    order = F.row_number().over(W.partitionBy("set").orderBy(F.desc("variance"), "gene"))
    pieces = cut_up.withColumn("piece", F.floor((order - 1) / F.lit(largest)))
    return _renamed(labelled.join(single, "set", "left_anti"), "root"), _renamed(pieces, "piece")


def _cut_large(corr: DataFrame, variance: DataFrame, parts: DataFrame, power: float, cut: float, largest: int) -> DataFrame:
    """Parts (dataset, set, gene) of at most ``largest`` genes: larger ones are cut again, deeper at each level."""
    final: list[DataFrame] = []
    while True:
        large = parts.groupBy("set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest).select("set")
        final.append(parts.join(large, "set", "left_anti"))
        parts = written(parts.join(large, "set", "left_semi"))
        if parts.isEmpty():
            break
        distances = written(_distances(corr, parts, power))
        labelled = written(roots(linkage(distances, cut), parts, "gene"))
        whole = written(labelled.groupBy("set").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("set"))
        divided = _renamed(labelled.join(whole, "set", "left_anti"), "root")
        if not whole.isEmpty():
            again, pieces = _forced(distances, parts.join(whole, "set", "left_semi"), variance, largest)
            divided, final = divided.unionByName(again), [*final, pieces]
        parts, cut = written(divided), max(LEAST_CUT, cut - CUT_STEP)
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return written(out)


class _Rows:
    """Rows of a symmetric table (p, q, total) of clusters: fetched in batches, at most ``HELD`` in memory."""

    def __init__(self, table: DataFrame, k: int):
        self.table, self.k, self.held = table, k, {}

    def take(self, p: int, soon: list[int]) -> np.ndarray:
        if p not in self.held:
            wanted = [p, *[q for q in soon if q not in self.held and q != p][: FETCHED - 1]]
            while len(self.held) + len(wanted) > HELD:
                del self.held[next(iter(self.held))]
            for r in self.table.filter(F.col("p").isin(wanted)).collect():
                row = self.held.setdefault(r["p"], np.zeros(self.k))
                row[r["q"]] = r["total"]
        return self.held.pop(p)


def _gathered(sizes: np.ndarray, own: np.ndarray, rows: _Rows, least: int, largest: int) -> np.ndarray:
    """Number of the group each small cluster joins, -1 for none.  Clusters come by falling size.

    The first free cluster takes, one after another, the free cluster with the best correlation of centroids among those
    that still fit, the earlier one on ties, until the group is large enough or nothing fits.  Every cluster's row of
    sums is used once.
    """
    free, group = np.ones(len(sizes), bool), np.full(len(sizes), -1)
    for seed in range(len(sizes)):
        if not free[seed]:
            continue
        free[seed] = False
        taken, size, inner = [seed], int(sizes[seed]), float(own[seed])
        row = rows.take(seed, np.flatnonzero(free)[:FETCHED].tolist()) if size < least else None
        while size < least:
            fits = np.flatnonzero(free & (sizes + size <= largest))
            if not len(fits):
                break
            scale = np.sqrt(np.maximum(inner / size**2 * own[fits] / sizes[fits] ** 2, 0.0))
            score = np.where(scale > TINY, row[fits] / (size * sizes[fits]) / np.where(scale > TINY, scale, 1.0), 0.0)
            best = int(fits[np.argmax(score)])
            free[best] = False
            inner += 2 * row[best] + own[best]
            size += int(sizes[best])
            taken.append(best)
            if size < least:
                row = row + rows.take(best, fits[np.argsort(-score, kind="stable")[:FETCHED]].tolist())
        if size >= least:
            group[taken] = seed
    return group


def _join_small(cov: DataFrame, small: DataFrame, least: int, largest: int) -> DataFrame:
    """Members (dataset, set, gene) of the groups that small clusters form; what stays small is left out."""
    spark = small.sparkSession
    listed = small.groupBy("dataset", "set").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("first"))
    clusters = written(listed.withColumn("p", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("n"), "first")) - 1))
    member = small.join(clusters.select("set", "p"), "set").select("dataset", "gene", "p")
    side = lambda g, p: member.select("dataset", F.col("gene").alias(g), F.col("p").alias(p))
    both = cov.withColumnRenamed("module", "dataset").join(side("i", "p"), ["dataset", "i"]).join(side("j", "q"), ["dataset", "j"])
    # Within a cluster a pair of genes counts twice, between two clusters once for each of their orders.
    turned = both.filter("i <> j").select("dataset", F.col("q").alias("p"), F.col("p").alias("q"), "cov")
    # Sorted, so that a fetch reads only the row groups that hold its rows.
    sums = written(both.select("dataset", "p", "q", "cov").unionByName(turned).groupBy("dataset", "p", "q").agg(F.sum("cov").alias("total"))
                       .repartitionByRange("dataset", "p").sortWithinPartitions("dataset", "p"))
    found = []
    for (dataset,) in clusters.select("dataset").distinct().collect():
        own = clusters.filter(F.col("dataset") == dataset).join(
            sums.filter((F.col("dataset") == dataset) & (F.col("p") == F.col("q"))).select("p", "total"), "p").orderBy("p").select("n", "total").toPandas()
        table = sums.filter(F.col("dataset") == dataset)
        group = _gathered(own["n"].to_numpy(), own["total"].to_numpy(), _Rows(table, len(own)), least, largest)
        found += [(dataset, p, int(g)) for p, g in enumerate(group) if g >= 0]
    groups = spark.createDataFrame(found, "dataset string, p int, seed int")
    return member.join(groups, ["dataset", "p"]).select(
        "dataset", F.concat_ws("/", "dataset", F.lit("joined"), "seed").alias("set"), "gene")


def _sized(cov: DataFrame, corr: DataFrame, variance: DataFrame, raw: DataFrame, power: float, cut: float, least: int, largest: int) -> DataFrame:
    """Clusters (dataset, set, gene) of ``least`` to ``largest`` genes from raw ones."""
    parts = _cut_large(corr, variance, raw, power, cut, largest)
    small = written(parts.groupBy("set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).select("set"))
    kept = parts.join(small, "set", "left_anti")
    if not small.isEmpty():
        kept = kept.unionByName(_join_small(cov, parts.join(small, "set", "left_semi"), least, largest))
    fits = kept.groupBy("set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, largest)).select("set")
    return written(kept.join(fits, "set", "left_semi"))


def gene_modules(cov: DataFrame, power: float = 6, cut: float = 0.7, least: int = 20, largest: int = 120) -> DataFrame:
    """(dataset, module_no, gene, order_in_module) from the covariance of each dataset; larger modules come first, of
    equal ones that with the lower first gene.  A dataset whose clusters all stay too small is taken as one cluster."""
    cov = written(cov.select(F.col("module").cast("string").alias("module"), "i", "j", "cov"))
    variance = cov.filter("i = j").select(F.col("module").alias("dataset"), F.col("i").alias("gene"), F.col("cov").alias("variance"))
    corr = written(gene_correlations(cov))
    everything = written(variance.select("dataset", F.concat_ws("/", "dataset", F.lit("all")).alias("set"), "gene"))
    if everything.isEmpty():
        return everything.select("dataset", F.lit(0).alias("module_no"), "gene", F.lit(0).alias("order_in_module"))
    first = linkage(_distances(corr, everything, power), cut)
    raw = written(_renamed(roots(first, everything, "gene"), "root"))
    found = _sized(cov, corr, variance, raw, power, cut, least, largest)
    rest = written(everything.join(found.select("dataset").distinct(), "dataset", "left_anti"))
    if not rest.isEmpty():
        found = found.unionByName(_sized(cov, corr, variance, rest, power, cut, least, largest))
    sizes = found.groupBy("dataset", "set").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("first"))
    number = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("n"), "first"))  # one row per module
    order = F.row_number().over(W.partitionBy("set").orderBy("gene"))  # at most ``largest`` rows
    return found.join(sizes.select("set", number.alias("module_no")), "set").select("dataset", "module_no", "gene", order.alias("order_in_module"))


def module_label(number: str = "module_no") -> Column:
    return F.format_string("M%03d", F.col(number))


def module_pair_priors(expr: DataFrame, activity: DataFrame, distal: DataFrame, n_genes: int, power: int = 6,
                       overall: DataFrame | None = None) -> DataFrame:
    """Allowed pairs per module: strongly adjacent, or ambiguous with promoter or shared distal support.

    ``expr`` and ``activity`` are long with dense genes per module, ``distal`` has (module, i, j) pairs sharing a
    distal peak.  ``overall`` (i, j, adjacency of all genes) makes the thresholds global.
    """
    adj = adjacency(correlations(expr, n_genes), power).filter("i < j")
    act = correlations(activity, n_genes).filter("i < j").select("module", "i", "j", F.abs("corr").alias("activity_corr"))
    limit = lambda df, value, keep, name: keep_threshold(df, ["module"], value, keep).withColumnRenamed("threshold", name)
    rows = adj.join(act, ["module", "i", "j"]).join(limit(act, "activity_corr", PROMOTER_SHARE, "_promoter"), "module")
    source = adj if overall is None else overall
    for keep, name in ((STRONG_SHARE, "_strong"), (AMBIGUOUS_SHARE, "_ambiguous")):
        rows = rows.join(limit(source, "adjacency", keep, name), "module")
    rows = rows.join(distal.select("module", "i", "j").distinct().withColumn("_shared", F.lit(True)), ["module", "i", "j"], "left")
    strong = F.col("adjacency") >= F.col("_strong")
    flagged = rows.select(
        "module", "i", "j", F.col("adjacency").alias("local_adjacency"),
        strong.alias("strong_edge"),
        ((F.col("adjacency") >= F.col("_ambiguous")) & ~strong).alias("ambiguous_edge"),
        (F.col("activity_corr") >= F.col("_promoter")).alias("promoter_support"),
        F.coalesce("_shared", F.lit(False)).alias("distal_support"),
    )
    ambiguous = F.col("ambiguous_edge")
    return flagged.filter(F.col("strong_edge") | (ambiguous & (F.col("promoter_support") | F.col("distal_support")))).withColumn(
        "support_rule", support_label(F.col("strong_edge"), ambiguous & F.col("promoter_support"), ambiguous & F.col("distal_support"))
    )


def module_centroids(expr: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean over member genes per (module, cell)."""
    return expr.join(membership, "gene").groupBy("module_no", "cell_id").agg(F.avg("value").alias("centroid"))
