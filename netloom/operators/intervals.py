"""Genomic interval joins and the links built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import rounded_exp
from ..functions.text import anchor_distance, canonical_token, format_interval, parse_interval, strip_version
from .ranks import top_k
from .sparse import centred_ranks, sparse_rank_correlations, stored, zero_filled_quantile

# Decay length of distal links, smallest usable sum.
DECAY = 200_000.0
TINY = 1e-8


def overlap_join(anchors: DataFrame, intervals: DataFrame, window: int, bin_size: int | None = None) -> DataFrame:
    """Anchor-interval pairs on one chromosome with start <= pos + window and end >= pos - window (both closed).

    ``anchors`` has chrom and pos, ``intervals`` chrom, start and end.  Bins come in levels, each twice as wide as the
    one before.  An interval is filed at the first level whose bins are no shorter than itself, so under two bins at
    most; anchors look at the few bins their window covers at each level in use.  A pair meets on (chrom, level, bin)
    and only the first common bin reports it, which saves a distinct.
    """
    base = F.lit(int(bin_size or max(1, 2 * window)))
    level = F.ceil(F.log2(F.greatest((F.col("end") - F.col("start")) / base, F.lit(1.0)))).cast("int")
    bin_of = lambda c: F.floor(c / (base * F.pow(F.lit(2.0), F.col("_level"))))
    levels = F.sequence(F.lit(0), F.coalesce(intervals.agg(F.max(level)).scalar(), F.lit(0)))
    filed = intervals.withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))))
    asking = (
        anchors.filter("pos is not null")
        .withColumn("_left", F.col("pos") - window)
        .withColumn("_right", F.col("pos") + window)
        .withColumn("_level", F.explode(levels))
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_left")), bin_of(F.col("_right")))))
    )
    met = asking.join(filed, ["chrom", "_level", "_bin"]).filter((F.col("start") <= F.col("_right")) & (F.col("end") >= F.col("_left")))
    first = F.greatest(bin_of(F.col("_left")), bin_of(F.col("start")))
    return met.filter(F.col("_bin") == first).drop("_bin", "_level", "_left", "_right")


def two_tier_candidates(anchors: DataFrame, peaks: DataFrame, promoter_window: int = 2000, distal_window: int = 150_000) -> DataFrame:
    """(gene_id, peak_id, tier): promoter hits, and distal hits that are not promoter hits.

    One join over the wider window decides both tiers.
    """
    met = overlap_join(anchors, peaks, max(promoter_window, distal_window))
    within = lambda w: (F.col("start") <= F.col("pos") + w) & (F.col("end") >= F.col("pos") - w)
    tier = F.when(within(promoter_window), F.lit("promoter")).when(within(distal_window), F.lit("distal"))
    return met.withColumn("tier", tier).filter("tier is not null")


def to_local_ids(candidates: DataFrame, mapping: DataFrame, ident: str = "peak_id") -> DataFrame:
    """Candidates whose peak has a local id."""
    return candidates.join(mapping, ident)


def candidate_ids(candidates: DataFrame, ident: str = "peak_id") -> DataFrame:
    return candidates.select(ident).distinct()


def resolve_anchors(features: DataFrame, tss: DataFrame) -> DataFrame:
    """Anchor of each feature: by name, id, id without version, else its own interval start.

    ``tss`` has key, chrom and pos.  Adds ``anchor`` (chrom, start) and ``anchor_source``.
    """
    found = features.withColumn("_plain", strip_version(F.col("feature_id")))
    for key, out in (("name", "_a"), ("feature_id", "_b"), ("_plain", "_c")):
        side = tss.select(F.col("key").alias(key), F.struct("chrom", F.col("pos").alias("start")).alias(out))
        found = found.join(side, key, "left")
    own = parse_interval(F.col("interval"))
    fallback = F.when(own.isNotNull(), F.struct(own["chrom"].alias("chrom"), own["start"].alias("start")))
    by_list = F.coalesce("_a", "_b", "_c")
    # Source labels.
    source = (
        F.when(by_list.isNotNull(), F.lit("gtf_tss")).when(fallback.isNotNull(), F.lit("h5_interval_start")).otherwise(F.lit("missing"))
    )
    return found.withColumn("anchor", F.coalesce(by_list, fallback)).withColumn("anchor_source", source).drop("_plain", "_a", "_b", "_c")


def resolve_symbols(features: DataFrame, aliases: DataFrame) -> DataFrame:
    """Symbol of the first canonical alias known (name, id, plain id), else the name, else the id."""
    tokens = {
        "_k1": canonical_token(F.col("name")),
        "_k2": canonical_token(F.col("feature_id")),
    }
    found = features
    for key, token in tokens.items():
        side = aliases.select(F.col("alias").alias(key), F.col("symbol").alias(f"{key}_s"))
        found = found.withColumn(key, token).join(side, key, "left")
    plain = lambda c: F.when(F.length(c) > 0, F.col(c))
    symbol = F.coalesce("_k1_s", "_k2_s", plain("name"), F.col("feature_id"))
    return found.withColumn("gene_symbol", symbol).drop(*tokens, *[f"{k}_s" for k in tokens])


def anchor_histogram(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("anchor_source").agg(F.count(F.lit(1)).alias("genes"))


def _series(df: DataFrame, ident: str, listed: DataFrame, n_cells, out_id: str) -> tuple[DataFrame, DataFrame]:
    """Ranks and facts of sparse series, named for one side of a pair."""
    rows = df.select(F.col(ident).alias(out_id), "cell_id", F.col("value").cast("double").alias("value"))
    return centred_ranks(rows, listed.select(F.col(ident).alias(out_id)), [out_id], n_cells)


def peak_medians(access: DataFrame, listed: DataFrame, n_cells, peak: str = "peak_id", value: str = "value") -> DataFrame:
    """Median of each listed peak over all cells; entries that are not stored are 0."""
    return zero_filled_quantile(access, listed, [peak], n_cells, 0.5, value, "peak_accessibility_median")


def peak_gene_links(genes: DataFrame, peaks: DataFrame, expression: DataFrame, access: DataFrame, n_cells,
                    window: int = 250_000, threshold: float = 0.1) -> DataFrame:
    """Peaks near a gene's anchor whose accessibility follows its expression: Spearman above ``threshold``.

    ``genes`` has gene_id, anchor and labels; ``peaks`` peak_id, peak_name, chrom, start, end; ``expression`` and
    ``access`` are long matrices (gene_id / peak_id, cell_id, value) of ``n_cells`` cells in which zeros may be left out.
    Series are joined for nearby pairs only, in cells where both have an entry.
    """
    near = overlap_join(
        genes.filter("anchor is not null").select("gene_id", F.col("anchor.chrom").alias("chrom"), F.col("anchor.start").alias("pos")),
        peaks.select("peak_id", "chrom", "start", "end"), window,
    ).select(F.col("gene_id").alias("left_id"), F.col("peak_id").alias("right_id"))
    corr = sparse_rank_correlations(
        near, _series(expression, "gene_id", genes, n_cells, "left_id"), _series(access, "peak_id", peaks, n_cells, "right_id"), n_cells,
    ).filter(F.col("corr") > threshold)
    interval = F.struct("chrom", "start", "end")
    return (
        corr.select(F.col("left_id").alias("gene_id"), F.col("right_id").alias("peak_id"), F.col("corr").alias("peak_gene_corr"))
        .join(genes, "gene_id")
        .join(peaks, "peak_id")
        .join(peak_medians(access, peaks, n_cells), "peak_id")
        .withColumn("peak_interval", format_interval(interval))
        .withColumn("distance_to_tss", anchor_distance(F.col("anchor"), interval))
        .withColumn("association_pass", F.lit(True))
    )


def distal_scores(pairs: DataFrame) -> DataFrame:
    """|corr| decayed by distance."""
    return pairs.withColumn("score", F.abs("corr") * rounded_exp(-F.col("distance") / F.lit(DECAY)))


def best_distal_links(scored: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` peaks of each gene by score, then only positive ones, with their share of the gene's total."""
    kept = top_k(scored, ["gene_id"], [F.desc("score"), F.asc("peak_id")], k, "retained_rank").filter("score > 0")
    total = kept.groupBy("gene_id").agg(F.greatest(F.sum("score"), F.lit(TINY)).alias("_total"))
    return kept.join(total, "gene_id").withColumn("share", F.col("score") / F.col("_total")).drop("_total")


def gene_access_support(candidates: DataFrame, expression: DataFrame, access: DataFrame, n_cells, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Gene activity per cell (promoter mean plus share-weighted distal signal) and the links behind it.

    Both matrices may leave out zeros; so does the activity: a gene and cell without a row have activity 0.
    """
    promoter = candidates.filter("tier = 'promoter'")
    distal = candidates.filter("tier = 'distal'").withColumn(
        "distance", F.abs(F.floor((F.col("start") + F.col("end")) / 2) - F.col("pos")).cast("double"))
    pairs = distal.select(F.col("gene_id").alias("left_id"), F.col("peak_id").alias("right_id"))
    corr = sparse_rank_correlations(
        pairs, _series(expression, "gene_id", candidates, n_cells, "left_id"), _series(access, "peak_id", candidates, n_cells, "right_id"), n_cells,
    ).select(F.col("left_id").alias("gene_id"), F.col("right_id").alias("peak_id"), "corr")
    kept = best_distal_links(distal_scores(distal.join(corr, ["gene_id", "peak_id"])), k)
    shares = promoter.join(promoter.groupBy("gene_id").agg((1.0 / F.count(F.lit(1))).alias("share")), "gene_id") \
        .select("gene_id", "peak_id", "share").unionByName(kept.select("gene_id", "peak_id", "share"))
    activity = shares.join(stored(access), "peak_id").groupBy("gene_id", "cell_id").agg(F.sum(F.col("share") * F.col("value")).alias("activity"))
    distance = F.abs(F.floor((F.col("start") + F.col("end")) / 2) - F.col("pos")).cast("double")
    links = promoter.select(
        "gene_id", "peak_id", F.lit("promoter").alias("link_kind"), distance.alias("distance_to_anchor"),
        F.lit(1.0).alias("link_score"), F.lit(0).alias("retained_rank"),
    ).unionByName(kept.select(
        "gene_id", "peak_id", F.lit("distal").alias("link_kind"), F.col("distance").alias("distance_to_anchor"),
        F.col("score").alias("link_score"), "retained_rank",
    ))
    return activity, links


def shared_distal_pairs(links: DataFrame) -> DataFrame:
    """Gene pairs i < j kept to at least one common distal peak.

    A peak keeps few genes because each gene keeps few peaks within one window of it.
    """
    left = links.select(F.col("gene_id").alias("i"), "peak_id")
    right = links.select(F.col("gene_id").alias("j"), "peak_id")
    return left.join(right, "peak_id").filter("i < j").select("i", "j").distinct()
