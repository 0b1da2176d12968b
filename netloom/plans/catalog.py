"""One named query per operator over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import stats, text
from ..operators import (
    correlation, counts, features, graphs, intervals, katz, modules, motifs, neighborhoods, neighbors, normalize,
    orientation, priors, ranks, skeleton, sparse,
)
from ..session import cut_lineage, written
from ..sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ["module", "gene"]
LEVEL, FRACTION = 0.01, 0.1
DEEPEST = 20  # largest conditioning set, as in ``skeletons``


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _dimensions(spark, sf) -> int:
    """Genes of the expression view: the widest embedding of the table."""
    return views.table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0


def r6(c) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6) + F.lit(0.0)


# --- neighbourhoods and counts -------------------------------------------------------------------------------

def _bounds(expr: DataFrame) -> DataFrame:
    return neighborhoods.cell_neighborhoods(expr, FRACTION).select("cell_id", "gene", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query
def nbr_bounds(spark, sf):
    return _bounds(views.expression(spark, sf, relu=False))


@query
def nbr_bounds_relu(spark, sf):
    return _bounds(views.expression(spark, sf))


@query
def nbr_bounds_by_label(spark, sf):
    expr = views.expression(spark, sf, by_label=True)
    return neighborhoods.cell_neighborhoods(expr, FRACTION).select("module", "cell_id", "gene", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query
def nbr_bounds_ties(spark, sf):
    ties = neighborhoods.tie_neighborhoods(views.tied_values(spark, sf), FRACTION)
    return ties.select("gene", "value", "tie_start", "tie_size", "lo", "hi")


@query
def nbr_size(spark, sf):
    return neighborhoods.neighborhood_sizes(views.expression(spark, sf, relu=False), FRACTION).select("cell_id", "gene", "members")


@query
def nbr_size_relu(spark, sf):
    return neighborhoods.neighborhood_sizes(views.expression(spark, sf), FRACTION).select("cell_id", "gene", "members")


@query
def count_pair(spark, sf):
    return counts.pair_counts(views.expression(spark, sf), FRACTION).select("cell_id", "a", "b", "c_a", "c_b", "c_ab")


@query
def count_pair_ties(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    names = ("l_quantity", "l_discount", "l_tax")
    pairs = F.array(*[
        F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(names[i]).alias("va"), F.col(names[j]).alias("vb"))
        for i in range(3) for j in range(i + 1, 3)])
    points = lines.select(F.lit("all").alias("module"), F.inline(pairs)).groupBy("module", "a", "b", "va", "vb").agg(
        F.count(F.lit(1)).alias("weight"))
    ties = neighborhoods.tie_neighborhoods(views.tied_values(spark, sf), FRACTION)
    return counts.dyadic_pair_counts(ties, points).select("a", "b", "va", "vb", "weight", "members")


@query
def count_joint(spark, sf):
    first, second = views.expression(spark, sf), views.expression(spark, sf, relu=False)
    vectors = counts.joint_vectors(first, second, FRACTION)
    own = lambda genes: [(g, g + genes // 2) for g in range(genes // 2)]
    return counts.over_pairs(vectors, pairs=own).select("cell_id", F.col("a").alias("gene"), F.col("c_ab").alias("members"))


def _pair_tests(spark, sf) -> DataFrame:
    cells = views.table(spark, sf, "embeddings").count()
    return counts.pair_counts(views.expression(spark, sf), FRACTION).withColumn("c_z", F.lit(cells).cast("long"))


@query
def ci_level0(spark, sf):
    tests = _pair_tests(spark, sf)
    four = [F.col(c) for c in ("c_z", "c_a", "c_b", "c_ab")]
    return tests.select("cell_id", "a", "b", r6(stats.z_score(*four)).alias("z"),
                        stats.independent(*four, LEVEL).alias("separates"))


@query
def pair_uncond_z(spark, sf):
    tests = _pair_tests(spark, sf)
    four = [F.col(c) for c in ("c_z", "c_a", "c_b", "c_ab")]
    return tests.groupBy("a", "b").agg(
        F.sum(stats.independent(*four, LEVEL).cast("int")).cast("bigint").alias("independent_cells"),
        r6(F.max(F.abs(stats.z_score(*four)))).alias("strongest_z"))


@query
def pair_uncond_p(spark, sf):
    tests = _pair_tests(spark, sf)
    four = [F.col(c) for c in ("c_z", "c_a", "c_b", "c_ab")]
    return tests.select("cell_id", "a", "b", r6(stats.two_sided_p(stats.z_score(*four))).alias("p"))


def _level_one(spark, sf) -> DataFrame:
    """The skeleton of every cell after the tests given one gene, one row a cell."""
    return skeleton.linked_skeletons(views.expression(spark, sf), FRACTION, LEVEL)


@query
def count_triple(spark, sf):
    vectors = written(counts.cell_vectors(neighborhoods.cell_neighborhoods(views.expression(spark, sf), FRACTION)))
    return counts.triple_counts(vectors, skeleton.marginal_masks(vectors, LEVEL)).select("cell_id", "g0", "g1", "g2", "members")


@query
def ci_level1(spark, sf):
    vectors = written(counts.cell_vectors(neighborhoods.cell_neighborhoods(views.expression(spark, sf), FRACTION)))
    found = skeleton.single_outcomes(vectors, LEVEL)
    z = stats.z_score(*[F.col(c) for c in ("c_z", "c_xz", "c_yz", "c_xyz")])
    return found.select("cell_id", "a", "b", "given", "pool",
                        "c_z", "c_xz", "c_yz", "c_xyz", F.when(F.col("c_z") > 1, r6(z)).alias("z"), "separates")


@query
def skeleton_l0(spark, sf):
    return skeleton.marginal_edges(views.expression(spark, sf), FRACTION, LEVEL).select("cell_id", "a", "b")


@query
def skeleton_l1(spark, sf):
    edges, _ = skeleton.linked_rows(_level_one(spark, sf))
    return edges.select("cell_id", "a", "b")


@query
def sepsets_l1(spark, sf):
    _, found = skeleton.linked_rows(_level_one(spark, sf))
    return found.select("cell_id", "a", "b", F.get("sepset", F.lit(0)).alias("given"))


def _level_one_arcs(spark, sf) -> DataFrame:
    return orientation.collider_linked(_level_one(spark, sf))


@query
def collider_edges(spark, sf):
    return graphs.linked_edges(_level_one_arcs(spark, sf)).select("cell_id", "src", "dst")


@query
def orientation_closure(spark, sf):
    """In every cell's skeleton each gene's strongest source is known to come before it; the rules carry that further."""
    known = cut_lineage(_dimension_prior(spark, sf).filter("rank = 1").select("module", "src", "dst"))
    against = orientation.directed_only(known).select("module", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return orientation.close_linked(_dag(spark, sf), against).select("cell_id", "src", "dst")


def _full_graphs(spark, sf, stable: bool) -> DataFrame:
    arcs = orientation.collider_linked(skeleton.linked_full_skeletons(views.expression(spark, sf), DEEPEST, FRACTION, LEVEL, stable))
    nodes = views.table(spark, sf, "embeddings").select(F.lit("all").alias("module"), F.col("vec_id").alias("cell_id"), F.lit(_dimensions(spark, sf)).alias("n_genes"))
    return orientation.directed_graphs(arcs, nodes)


@query
def cell_graph_full(spark, sf):
    return _full_graphs(spark, sf, True).select("cell_id", F.inline("edges"))


@query
def cell_graph_orig(spark, sf):
    return _full_graphs(spark, sf, False).select("cell_id", F.inline("edges"))


@query
def cell_graph_summary(spark, sf):
    packed = _full_graphs(spark, sf, True)
    return packed.select("cell_id", F.size("edges").alias("edge_count"), "fallback")


# --- priors --------------------------------------------------------------------------------------------------

def _dimension_prior(spark, sf) -> DataFrame:
    """|corr| of dimensions as directed weights, the five strongest sources per target."""
    corr = correlation.correlations(views.expression(spark, sf), _dimensions(spark, sf)).filter("i < j")
    weighted = corr.select("module", "i", "j", F.round(F.abs("corr"), 9).alias("w")).filter("w > 0")
    both = correlation.mirrored(weighted, "w").select("module", F.col("i").alias("src"), F.col("j").alias("dst"), "w")
    return ranks.top_k(both, ["module", "dst"], [F.desc("w"), F.asc("src")], 5)


@query
def prior_topk(spark, sf):
    return _dimension_prior(spark, sf).select("src", "dst", "rank", r6("w").alias("w"))


@query
def prior_load(spark, sf):
    part = views.table(spark, sf, "part")
    raw = part.select(F.concat(F.lit(" "), "p_brand").alias("gene_left"),
                      F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("gene_right"),
                      (F.col("p_retailprice") - 900.0).alias("coarse_edge_count"))
    return priors.pair_prior(raw).select("a", "b", r6("w").alias("w"))


@query
def target_prior(spark, sf):
    genes = views.table(spark, sf, "part").select(F.explode(F.array("p_brand", "p_type")).alias("name")).distinct()
    genes = genes.select(F.lit("all").alias("module"), F.col("name").alias("gene"), "name")
    best = priors.target_prior(views.listed_priors(spark, sf), genes, 5)
    return priors.prior_weights(best).select("src", "dst", r6("w").alias("w"))


@query
def forbidden_pairs(spark, sf):
    prior = _dimension_prior(spark, sf)
    genes = views.expression(spark, sf).select("module", "gene").distinct()
    allowed = prior.select("module", F.col("src").alias("a"), F.col("dst").alias("b"))
    return priors.forbidden_pairs(genes, allowed).select("a", "b")


@query
def effective_alpha(spark, sf):
    strengths = priors.undirected_strength(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    raised = stats.effective_alpha(LEVEL, F.col("w"), F.col("w") / 2, gamma=2.0, motif_min=0.01)
    return strengths.select("a", "b", r6("w").alias("w"), r6(raised).alias("alpha"))


@query
def activity_prior(spark, sf):
    genes = views.expression(spark, sf).select("module", "gene", F.col("gene").cast("string").alias("name")).distinct()
    prior = _dimension_prior(spark, sf).withColumn("source", F.col("src").cast("string"))
    weights = priors.activity_weights(prior, views.expression(spark, sf), genes)
    return weights.select("cell_id", "src", "dst", r6("w").alias("w"))


@query
def orient_prior(spark, sf):
    prior = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    return orientation.orient_by_prior(_level_one_arcs(spark, sf), prior).select(
        "cell_id", "src", "dst", r6("satisfied").alias("satisfied"), "reversed", "conflict")


@query
def orient_totals(spark, sf):
    prior = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    totals = orientation.orientation_totals(orientation.orient_by_prior(_level_one_arcs(spark, sf), prior))
    return totals.select("module", "candidate_edges", "oriented_edges", r6("satisfied_weight").alias("satisfied_weight"),
                         r6("available_weight").alias("available_weight"), "reversed_edges", "conflict_edges")


@query
def orient_bidir(spark, sf):
    prior = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    return orientation.orient_mutual_by_prior(_level_one_arcs(spark, sf), prior).select("cell_id", "src", "dst")


@query
def orient_acyclic(spark, sf):
    prior = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    return orientation.orient_acyclic_by_prior(_level_one_arcs(spark, sf), prior).select("cell_id", "src", "dst", "state")


# --- normalisation, selection, ranks -------------------------------------------------------------------------

@query
def log_norm(spark, sf):
    return normalize.log_normalize(views.part_counts(spark, sf)).select("cell_id", "feature_id", r6("value").alias("value"))


@query
def log_norm_dense(spark, sf):
    events = views.event_counts(spark, sf)
    names = [r["feature_id"] for r in events.select("feature_id").distinct().orderBy("feature_id").toLocalIterator()]
    wide = events.groupBy("cell_id").pivot("feature_id", names).agg(F.first("count"))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0)).cast("double")
    scaled = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)) * (F.lit(1e4) / total))
    return wide.select("cell_id", *[r6(scaled(c)).alias(c) for c in names])


@query
def count_likeness(spark, sf):
    facts = normalize.count_likeness(views.part_counts(spark, sf), "count")
    return facts.select(r6("integer_share").alias("integer_share"), "top", "mode")


@query
def library_size(spark, sf):
    return normalize.library_sizes(views.part_counts(spark, sf))


@query
def tfidf(spark, sf):
    sparse = views.part_counts(spark, sf)
    cells = sparse.agg(F.countDistinct("cell_id")).scalar()
    return normalize.tf_idf(sparse, cells).select("cell_id", "feature_id", r6(F.col("weight") * 1000).alias("weight"))


def _suppliers(sparse: DataFrame) -> int:
    return sparse.select(F.countDistinct("cell_id")).first()[0]


@query
def feature_stats(spark, sf):
    sparse = views.part_counts(spark, sf)
    facts = features.feature_stats(sparse, _suppliers(sparse))
    return facts.select("feature_id", "detected", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query
def top_var_genes(spark, sf):
    sparse = views.part_counts(spark, sf)
    best = features.top_variable(sparse, _suppliers(sparse), 1000, 10)
    return best.select("feature_id", "detected", r6("variance").alias("variance"))


@query
def top_cells(spark, sf):
    return features.top_cells(normalize.library_sizes(views.part_counts(spark, sf)), 50)


@query
def variance_windows(spark, sf):
    facts = views.expression(spark, sf).groupBy("gene").agg(F.round(F.var_pop("value"), 9).alias("variance"))
    return features.variance_windows(facts).select(F.col("group_id").cast("int").alias("group_id"), "gene")


@query
def column_variance(spark, sf):
    facts = features.feature_stats(views.expression(spark, sf).withColumnRenamed("gene", "feature_id"), views.table(spark, sf, "embeddings").count(), "value")
    return facts.select(F.col("feature_id").alias("gene"), r6("variance").alias("variance"))


@query
def p95_scale(spark, sf):
    return normalize.open_scale(views.part_counts(spark, sf), "feature_id").select("cell_id", "feature_id", r6("access").alias("access"))


@query
def keep_threshold(spark, sf):
    found = normalize.keep_threshold(views.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.15)
    return found.select("l_returnflag", r6("threshold").alias("threshold"))


@query
def peak_median(spark, sf):
    raw = views.expression(spark, sf, relu=False)
    return intervals.peak_medians(raw, raw, views.table(spark, sf, "embeddings").count(), "gene", "value").select("gene", r6("peak_accessibility_median").alias("median"))


@query
def avg_rank(spark, sf):
    return ranks.average_rank(views.expression(spark, sf), KEYS).select("cell_id", "gene", "avg_rank")


@query
def avg_rank_ties(spark, sf):
    ties = ranks.tie_blocks(views.tied_values(spark, sf), KEYS)
    return ties.select("gene", "value", "tie_size", (F.col("tie_start") + (F.col("tie_size") + 1) / F.lit(2.0)).alias("avg_rank"))


@query
def zero_rank(spark, sf):
    return ranks.zero_preserving_rank(views.expression(spark, sf), KEYS).select("cell_id", "gene", r6("profile").alias("profile"))


@query
def ordinal_rank(spark, sf):
    return ranks.ordinal_rank_scale(views.expression(spark, sf), KEYS).select("cell_id", "gene", r6("scaled").alias("scaled"))


@query
def sort_position(spark, sf):
    return ranks.ordinal_position(views.expression(spark, sf), KEYS).select("cell_id", "gene", "position", "tie_start", "tie_size", "n_floor")


@query
def minmax(spark, sf):
    return normalize.min_max(views.expression(spark, sf, relu=False), KEYS, "value", "scaled").select("cell_id", "gene", r6("scaled").alias("scaled"))


@query
def minmax_customer(spark, sf):
    scaled = normalize.min_max(views.table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "scaled")
    return scaled.select("c_custkey", r6("scaled").alias("scaled"))


@query
def colmean(spark, sf):
    return katz.column_mean_scale(views.expression(spark, sf), KEYS).select("cell_id", "gene", r6("scaled").alias("scaled"))


def _beta(mode: str, blend: float) -> Query:
    def run(spark, sf):
        return katz.node_weights(views.expression(spark, sf), mode, blend).select("cell_id", "gene", r6("beta").alias("beta"))
    return run


for _mode, _blend in (("expression", 1.0), ("uniform", 1.0), ("blend", 0.6), ("clipped_blend", 0.6), ("rank_blend", 0.6)):
    QUERIES[f"beta_{_mode}"] = _beta(_mode, _blend)


# --- correlation and modules ---------------------------------------------------------------------------------

def _corr(spark, sf) -> DataFrame:
    return correlation.correlations(views.expression(spark, sf), _dimensions(spark, sf))


@query
def pearson(spark, sf):
    return _corr(spark, sf).select("i", "j", r6("corr").alias("corr"))


@query
def spearman(spark, sf):
    return correlation.rank_correlations(views.expression(spark, sf), _dimensions(spark, sf)).select("i", "j", r6("corr").alias("corr"))


@query
def adjacency(spark, sf):
    return correlation.adjacency(_corr(spark, sf), 2).select("i", "j", r6("adjacency").alias("adjacency"))


@query
def tom(spark, sf):
    adj = cut_lineage(correlation.adjacency(_corr(spark, sf), 2))
    return correlation.topological_overlap(adj, _dimensions(spark, sf)).select("i", "j", r6("tom").alias("tom"))


@query
def shared_support(spark, sf):
    links = _dimension_prior(spark, sf).select(F.col("dst").alias("gene_id"), F.col("src").alias("peak_id"))
    return intervals.shared_distal_pairs(links)


@query
def pair_priors(spark, sf):
    expr = views.expression(spark, sf, by_label=True)
    activity = views.expression(spark, sf, relu=False, by_label=True)
    links = _dimension_prior(spark, sf).select(F.col("dst").alias("gene_id"), F.col("src").alias("peak_id"))
    every = expr.select("module").distinct()
    distal = intervals.shared_distal_pairs(links).withColumn("module", F.explode(every.agg(F.collect_set("module")).scalar()))
    found = modules.module_pair_priors(expr, activity, distal, _dimensions(spark, sf))
    return found.select("module", "i", "j", r6("local_adjacency").alias("local_adjacency"), "strong_edge", "ambiguous_edge",
                        "promoter_support", "distal_support", "support_rule")


@query
def wgcna_modules(spark, sf):
    cov = modules.covariances(views.expression(spark, sf, relu=False), _dimensions(spark, sf))
    return modules.gene_modules(cov, power=1, cut=0.9, least=4, largest=16)


@query
def module_summary(spark, sf):
    return features.module_summary(views.table(spark, sf, "embeddings"), "label")


@query
def module_order(spark, sf):
    listed = views.table(spark, sf, "embeddings").select("label", "vec_id")
    return features.order_in_group(listed, ["label"], "vec_id").select("label", "vec_id", "order_in_module")


@query
def module_centroid(spark, sf):
    membership = views.expression(spark, sf).select("gene", F.floor(F.col("gene") / 8).cast("int").alias("module_no")).distinct()
    return modules.module_centroids(views.expression(spark, sf), membership).select("module_no", "cell_id", r6("centroid").alias("centroid"))


@query
def module_labels(spark, sf):
    parts = views.table(spark, sf, "part").select(F.col("p_partkey").alias("gene"))
    members = views.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("module_no"))
    return features.modules_to_labels(parts, members)


@query
def module_concat(spark, sf):
    by_label = views.expression(spark, sf, by_label=True).select("module", "cell_id", "gene", F.col("value").alias("score"))
    all_cells = views.expression(spark, sf, relu=False).select(F.lit("A").alias("module"), "cell_id", "gene", F.col("value").alias("score"))
    return katz.first_module_scores(by_label.unionByName(all_cells.filter("score > 0"))).select("cell_id", "gene", r6("score").alias("score"))


@query
def score_matrix(spark, sf):
    scores = views.expression(spark, sf).withColumnRenamed("value", "score").withColumn("gene", F.concat(F.lit("g"), F.col("gene").cast("string")))
    wide = katz.score_matrix(scores, [f"g{i}" for i in range(_dimensions(spark, sf))])
    return wide.select("cell_id", *[r6(f"g{i}").alias(f"g{i}") for i in range(_dimensions(spark, sf))])


# --- intervals, names, motifs --------------------------------------------------------------------------------

@query
def interval_join(spark, sf):
    return intervals.overlap_join(views.order_anchors(spark, sf), views.line_intervals(spark, sf), 30).select("gene_id", "peak_id")


@query
def two_tier(spark, sf):
    found = intervals.two_tier_candidates(views.order_anchors(spark, sf), views.line_intervals(spark, sf), 10, 90)
    return found.select("gene_id", "peak_id", "tier", F.abs(F.floor((F.col("start") + F.col("end")) / 2) - F.col("pos")).alias("distance"))


def _named_suppliers(spark, sf) -> DataFrame:
    s = F.col("s_suppkey").cast("string")
    where = F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"), F.lit(":"), (F.col("s_suppkey") * 100).cast("string"),
                     F.lit("-"), (F.col("s_suppkey") * 100 + 50).cast("string"))
    return views.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.concat(s, F.lit("."), F.col("s_nationkey").cast("string")).alias("feature_id"),
        F.when(F.col("s_acctbal") > 0, where).otherwise(F.lit("unplaced")).alias("interval"))


def _starts(spark, sf) -> DataFrame:
    return views.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")).alias("chrom"),
        (F.col("n_nationkey") * 1000).cast("bigint").alias("pos"))


@query
def anchor_resolve(spark, sf):
    found = intervals.resolve_anchors(_named_suppliers(spark, sf), _starts(spark, sf))
    return found.select("name", F.col("anchor.chrom").alias("chrom"), F.col("anchor.start").alias("pos"), "anchor_source")


@query
def anchor_hist(spark, sf):
    return intervals.anchor_histogram(intervals.resolve_anchors(_named_suppliers(spark, sf), _starts(spark, sf)))


@query
def symbol_resolve(spark, sf):
    aliases = views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("alias"), F.col("n_name").alias("symbol"))
    return intervals.resolve_symbols(_named_suppliers(spark, sf), aliases).select("name", "feature_id", "gene_symbol")


@query
def links_topk(spark, sf):
    line = views.table(spark, sf, "lineitem")
    order = views.table(spark, sf, "orders")
    gap = F.abs(F.datediff("l_shipdate", "o_orderdate")) * 1000.0
    pairs = (
        line.join(order, line["l_orderkey"] == order["o_orderkey"])
        .select(F.col("o_custkey").alias("gene_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("peak_id"),
                (F.col("l_discount") - 0.05).alias("corr"), gap.alias("distance"))
        .groupBy("gene_id", "peak_id").agg(F.max("corr").alias("corr"), F.min("distance").alias("distance"))
    )
    best = intervals.best_distal_links(intervals.distal_scores(pairs), 5)
    return best.select("gene_id", "peak_id", "retained_rank", r6("score").alias("score"), r6("share").alias("share"))


@query
def peak_gene_links(spark, sf):
    """Dimensions as genes and peaks at 1,000 apart; peaks follow the raw, genes the rectified values."""
    genes = views.expression(spark, sf).select(F.col("gene").alias("gene_id")).distinct().withColumn(
        "anchor", F.struct(F.lit("chr1").alias("chrom"), (F.col("gene_id") * 1000).cast("bigint").alias("start")))
    peaks = genes.select(F.col("gene_id").alias("peak_id"), F.concat(F.lit("p"), F.col("gene_id").cast("string")).alias("peak_name"),
                         F.lit("chr1").alias("chrom"), (F.col("gene_id") * 1000).cast("bigint").alias("start"),
                         (F.col("gene_id") * 1000 + 400).cast("bigint").alias("end"))
    dense = lambda relu, name: views.expression(spark, sf, relu).select(F.col("gene").alias(name), "cell_id", "value")
    found = intervals.peak_gene_links(genes, peaks, dense(True, "gene_id"), dense(False, "peak_id"), views.table(spark, sf, "embeddings").count(), 4000, 0.05)
    return found.select("gene_id", "peak_name", "peak_interval", r6("peak_gene_corr").alias("corr"), "distance_to_tss",
                        r6("peak_accessibility_median").alias("median"))


@query
def gene_activity(spark, sf):
    genes = views.expression(spark, sf).select(F.col("gene").alias("gene_id")).distinct()
    anchors = genes.select("gene_id", F.lit("chr1").alias("chrom"), (F.col("gene_id") * 1000).cast("bigint").alias("pos"))
    peaks = genes.select(F.col("gene_id").alias("peak_id"), F.lit("chr1").alias("chrom"),
                         (F.col("gene_id") * 1000).cast("bigint").alias("start"), (F.col("gene_id") * 1000 + 400).cast("bigint").alias("end"))
    near = intervals.two_tier_candidates(anchors, peaks, 500, 6000)
    dense = lambda relu, name: views.expression(spark, sf, relu).select(F.col("gene").alias(name), "cell_id", "value")
    activity, _ = intervals.gene_access_support(near, dense(True, "gene_id"), dense(True, "peak_id"), views.table(spark, sf, "embeddings").count(), 5)
    every = dense(True, "gene_id").select("gene_id", "cell_id").join(activity, ["gene_id", "cell_id"], "left")  # the view names every cell
    return every.select("gene_id", "cell_id", r6(F.coalesce("activity", F.lit(0.0))).alias("activity"))


def _part_profiles(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Brand and size as a gene, its parts as peaks, quantity sold per supplier as access: sparse profiles and the profiled genes."""
    access = written(views.part_counts(spark, sf).withColumn("peak_name", F.col("feature_id").cast("string")))  # read for quantiles and shares
    name = F.concat_ws("/", "p_brand", "p_size")
    links = views.table(spark, sf, "part").select(name.alias("gene_module_column"), F.col("p_partkey").cast("string").alias("peak_name"), (F.col("p_size") / 50.0).alias("peak_gene_corr"))
    genes = links.select(F.lit("all").alias("module"), F.col("gene_module_column").alias("gene"), F.col("gene_module_column").alias("name")).distinct()
    usable = priors.usable_links(links, genes)
    scaled = normalize.open_scale(access, "peak_name").select("peak_name", "cell_id", "access")
    return written(priors.gene_profiles(usable, scaled, "max", 0.6).filter("value <> 0")), usable.select("module", "gene").distinct()


@query
def joint_profiles(spark, sf):
    """Stored profile values with their neighbourhoods; the zeros of a gene are one row without a cell."""
    profiles, listed = _part_profiles(spark, sf)
    near, zeros = sparse.sparse_neighborhoods(profiles, listed, views.table(spark, sf, "supplier").count(), FRACTION, 0.6)
    shown = ("gene", "cell_id", r6("value").alias("value"), r6("lo").alias("lo"), r6("hi").alias("hi"))
    return near.select(*shown).unionByName(zeros.withColumn("cell_id", F.lit(None).cast("bigint")).select(*shown))


@query
def make_unique(spark, sf):
    named = views.table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("feature_id"), F.col("p_partkey").alias("ordinal"))
    return features.unique_names(named).select("feature_id", "unique_name")


@query
def canon_token(spark, sf):
    raw = F.concat(F.lit("  "), "p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit(".x "))
    return views.table(spark, sf, "part").select("p_partkey", text.canonical_token(raw).alias("token"))


@query
def strip_version(spark, sf):
    raw = F.concat(F.lit(" id"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return views.table(spark, sf, "part").select("p_partkey", text.strip_version(raw).alias("token"))


@query
def parse_interval(spark, sf):
    found = _named_suppliers(spark, sf).withColumn("parsed", text.parse_interval(F.col("interval")))
    return found.select("name", "parsed.chrom", "parsed.start", "parsed.end", text.interval_center(F.col("parsed")).alias("center"))


@query
def attribute_parse(spark, sf):
    line = F.concat(F.lit('gene_id "G'), F.col("s_suppkey").cast("string"), F.lit('.1"; gene_name "'), "s_name", F.lit('"; level 2;'))
    found = views.table(spark, sf, "supplier").withColumn("m", text.attribute_map(line))
    return found.select("s_suppkey", *[F.col("m")[k].alias(k) for k in ("gene_id", "gene_name", "level")])


@query
def motif_name_tokens(spark, sf):
    raw = F.concat("p_brand", F.lit(" (var.2)::"), "p_type", F.lit(".3"))
    return views.table(spark, sf, "part").select("p_partkey", F.array_join(text.motif_tokens(raw), "|").alias("tokens"))


def _language_motifs(spark, sf, width: int = 6) -> DataFrame:
    """Letter counts of each language's sequences by place modulo ``width``, as count matrices."""
    def tally(batches):
        for batch in batches:
            sums: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("sequence").to_pylist()):
                letters = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                own = sums.setdefault(lang, np.zeros((width, 4), np.int64))
                for p in range(width):
                    own[p] += [np.count_nonzero(letters[p::width] == ord(c)) for c in "ACGT"]
            for lang, own in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * width, pa.string()), "p": pa.array(range(1, width + 1), pa.int32()), **{c: pa.array(own[:, i].astype(float)) for i, c in enumerate("ACGT")}})

    parts = views.sequences(spark, sf).select("lang", "sequence").mapInArrow(tally, "lang string, p int, A double, C double, G double, T double")
    tallied = parts.groupBy("lang", "p").agg(*[F.sum(c).alias(c) for c in "ACGT"])
    return tallied.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("p", F.array(*"ACGT").alias("row")))).alias("r")).select(
        F.upper("lang").alias("tf_symbol"), F.lit(0).cast("bigint").alias("ordinal"), F.col("lang").alias("motif_id"),
        F.col("lang").alias("motif_name"), F.col("r.row").alias("counts"))


@query
def pssm_table(spark, sf):
    scored = motifs.log_odds(_language_motifs(spark, sf))
    return scored.select("motif_id", r6("min_score").alias("min_score"), r6("max_score").alias("max_score"))


@query
def pssm_scan(spark, sf):
    hits = motifs.scan_sequences(views.sequences(spark, sf), motifs.log_odds(_language_motifs(spark, sf)))
    return hits.select("peak_name", "tf_symbol", r6("rel_score").alias("rel_score"), r6("abs_score").alias("abs_score"))


@query
def triplets_best(spark, sf):
    """Brands regulate sizes through parts as peaks: hits, links and modules taken from part and lineitem."""
    part = views.table(spark, sf, "part")
    genes = part.select(F.col("p_type").alias("module"), F.col("p_brand").alias("module_column")).distinct().select(
        "module", "module_column", F.col("module_column").alias("gene_id"), F.col("module_column").alias("gene_symbol"))
    links = part.select(
        F.col("p_type").alias("module"), F.col("p_brand").alias("gene_module_column"), F.col("p_brand").alias("gene_symbol"),
        F.col("p_name").alias("peak_name"), F.lit("").alias("peak_interval"), (F.col("p_size") / 50.0).alias("peak_gene_corr"),
        (F.col("p_retailprice") / 10.0).alias("peak_median"), "p_partkey",
    ).groupBy("module", "gene_module_column", "gene_symbol", "peak_name", "peak_interval").agg(
        F.max("peak_gene_corr").alias("peak_gene_corr"), F.max("peak_median").alias("peak_median"))
    hits = part.groupBy(F.col("p_name").alias("peak_name"), F.upper("p_brand").alias("tf_symbol")).agg(
        (F.max("p_size") / 50.0).alias("rel_score")).withColumns({
            "abs_score": F.col("rel_score"), "motif_id": F.lit("m"), "motif_name": F.lit("m"), "position": F.lit(0).cast("bigint"), "strand": F.lit("+")})
    best = motifs.best_triplets(motifs.triplets(links, hits, genes))
    return best.select("module_id", "tf_module_column", "gene_module_column", r6("tf_target_score").alias("score"), "supporting_peak_name")


# --- graphs and propagation ----------------------------------------------------------------------------------

def _dag(spark, sf) -> DataFrame:
    """Marginal edges of every cell, lower to higher gene, as linked graphs."""
    nodes = views.table(spark, sf, "embeddings").select(F.lit("all").alias("module"), F.col("vec_id").alias("cell_id"), F.lit(_dimensions(spark, sf)).alias("n_genes"))
    return skeleton.marginal_graphs(views.expression(spark, sf), nodes, FRACTION, LEVEL)


@query
def csr_pack(spark, sf):
    packed = graphs.pack_linked(_dag(spark, sf))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return packed.select("cell_id", joined("node_ptr").alias("node_ptr"), joined("targets").alias("targets"))


@query
def csr_decode(spark, sf):
    return graphs.decode_graphs(graphs.pack_linked(_dag(spark, sf))).select("cell_id", "src", "dst")


@query
def topo_order(spark, sf):
    ordered = graphs.topological_orders(graphs.pack_linked(_dag(spark, sf)))
    return ordered.select("cell_id", F.posexplode("topo_order").alias("place", "gene"))


@query
def degrees(spark, sf):
    return graphs.degrees(graphs.linked_edges(_dag(spark, sf))).select("cell_id", "gene", "out_degree", "in_degree")


@query
def reach(spark, sf):
    return graphs.successor_closure(_dag(spark, sf)).select("cell_id", "src", "dst")


@query
def directed_part(spark, sf):
    return graphs.linked_edges(orientation.directed_linked(_level_one_arcs(spark, sf))).select("cell_id", "src", "dst")


@query
def undirected_part(spark, sf):
    return graphs.linked_edges(orientation.mutual_linked(_level_one_arcs(spark, sf))).select("cell_id", "src", "dst")


@query
def edges_supported(spark, sf):
    found = graphs.edges_in(graphs.linked_edges(_dag(spark, sf)), _dimension_prior(spark, sf).select("module", "src", "dst"))
    return found.groupBy("cell_id").agg(F.count(F.lit(1)).alias("supported_edges"))


def _coefficients(mode: str) -> Query:
    def run(spark, sf):
        weights = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
        found = graphs.linked_edges(katz.linked_coefficients(_dag(spark, sf), weights, 2.0, mode), "coef")
        return found.select("cell_id", "src", "dst", r6("coef").alias("coef"))
    return run


for _mode, _name in (("sum", "sum"), ("mean_out", "mean_out"), ("sym_degree", "sym")):
    QUERIES[f"edge_coeff_{_name}"] = _coefficients(_mode)


@query
def katz_dag(spark, sf):
    scores = katz.propagate_linked(katz.linked_coefficients(_dag(spark, sf)), katz.node_weights(views.expression(spark, sf)), 0.05)
    return scores.select("cell_id", "gene", r6("score").alias("score"))


@query
def katz_weighted(spark, sf):
    weights = cut_lineage(_dimension_prior(spark, sf).select("module", "src", "dst", "w"))
    coef = katz.linked_coefficients(_dag(spark, sf), weights, 2.0, "mean_out")
    scores = katz.propagate_linked(coef, katz.node_weights(views.expression(spark, sf), "blend", 0.6), 0.05)
    return scores.select("cell_id", "gene", r6("score").alias("score"))


@query
def katz_cyclic(spark, sf):
    both = _dag(spark, sf).withColumns({"src": F.concat("src", "dst"), "dst": F.concat("dst", "src")})
    scores = katz.propagate_linked(katz.linked_coefficients(both), katz.node_weights(views.expression(spark, sf)), 0.05)
    return scores.select("cell_id", "gene", r6("score").alias("score"))


@query
def score_full(spark, sf):
    linked = _full_graphs(spark, sf, True).select("module", "cell_id", F.col("edges.src").alias("src"), F.col("edges.dst").alias("dst"))
    scores = katz.propagate_linked(katz.linked_coefficients(linked), katz.node_weights(views.expression(spark, sf)), 0.05)
    return scores.select("cell_id", "gene", r6("score").alias("score"))


# --- neighbours and embeddings -------------------------------------------------------------------------------

def _vectors(spark, sf) -> DataFrame:
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"))


@query
def knn(spark, sf):
    return neighbors.nearest_neighbors(_vectors(spark, sf), 30).select("cell_id", "other", "rank", r6("distance").alias("distance"))


@query
def knn_graph(spark, sf):
    near = cut_lineage(neighbors.nearest_neighbors(_vectors(spark, sf), 30))
    return neighbors.neighbor_graph(near, _vectors(spark, sf)).select("cell_id", "other", r6("weight").alias("weight"))


@query
def shared_neighbors(spark, sf):
    """Cells close in both modalities: raw values as expression, positive dimensions as sparse access."""
    access = views.expression(spark, sf).filter("value > 0").select("cell_id", F.col("gene").alias("feature_id"), F.col("value").alias("count"))
    graph = neighbors.shared_neighbors(_vectors(spark, sf), access, _dimensions(spark, sf), 15, 20, 10)
    return graph.select("cell_id", "other", r6("weight").alias("weight"))


@query
def pca(spark, sf):
    return neighbors.principal_components(_vectors(spark, sf), 30).select("cell_id", F.posexplode("v").alias("component", "score"))


@query
def lsi(spark, sf):
    return neighbors.truncated_svd(_vectors(spark, sf), 30).select("cell_id", F.posexplode("v").alias("component", "score"))


@query
def nmf(spark, sf):
    cells, _ = neighbors.nonnegative_factors(views.expression(spark, sf), 8)
    return cells.select("cell_id", F.posexplode("v").alias("component", "weight"))


# --- filters, names and identities ---------------------------------------------------------------------------

@query
def pair_floor(spark, sf):
    """Listed pairs at or over a strength, and the same pairs with every weight 1."""
    part = views.table(spark, sf, "part")
    raw = part.select(F.col("p_brand").alias("gene_left"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("gene_right"), (F.col("p_size") / 50.0).alias("prior_strength"))
    strong = priors.strong_pairs(priors.pair_prior(raw), 0.4).select("a", "b", r6("w").alias("w"), F.lit("weighted").alias("mode"))
    return strong.unionByName(priors.strong_pairs(priors.pair_prior(raw), 0.4, True).select("a", "b", "w", F.lit("binary").alias("mode")))


@query
def usable_links(spark, sf):
    """Parts as links of their brand to their type and size: passed, positive, known, the strongest of each peak."""
    part = views.table(spark, sf, "part")
    links = part.select(
        F.col("p_brand").alias("gene_module_column"), F.concat_ws(" ", F.lit(" "), "p_type", "p_size").alias("peak_name"),
        ((F.col("p_retailprice") - 950.0) / 1000.0).cast("string").alias("peak_gene_corr"), (F.col("p_size") > 10).cast("string").alias("association_pass"))
    genes = part.filter("p_brand <> 'Brand#3'").select(F.lit("all").alias("module"), F.col("p_brand").alias("gene"), F.col("p_brand").alias("name")).distinct()
    return priors.usable_links(links, genes).select("gene", "peak_name", r6("weight").alias("weight"))


@query
def weighted_profiles(spark, sf):
    """Second-modality values as weighted sums of the peaks' access, small ones set to zero and left out."""
    part, access = views.table(spark, sf, "part"), views.part_counts(spark, sf)
    links = part.select(F.lit("all").alias("module"), F.concat_ws("/", "p_brand", "p_size").alias("gene"), F.col("p_partkey").alias("peak_name"), ((F.col("p_size") - 5) / 50.0).alias("weight"))
    scaled = normalize.open_scale(access, "feature_id").select(F.col("feature_id").alias("peak_name"), "cell_id", "access")
    return priors.gene_profiles(links, scaled, "weighted_sum", 0.3).filter("value <> 0").select("gene", "cell_id", r6("value").alias("value"))


@query
def feature_type(spark, sf):
    """Counts of one kind of feature."""
    listed = views.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("feature_type"))
    return features.of_type(views.part_counts(spark, sf), listed, "PROMO").select("cell_id", "feature_id", "count")


@query
def auto_log(spark, sf):
    """A matrix that looks like counts is scaled and logged; the same matrix already logged is left as it is."""
    counts_in = views.part_counts(spark, sf).select("cell_id", "feature_id", F.col("count").alias("value"))
    logged, mode = normalize.auto_log(counts_in)
    same, kept = normalize.auto_log(counts_in.withColumn("value", F.log1p("value")))
    show = lambda df, m: df.select("cell_id", "feature_id", r6("value").alias("value"), F.lit(m).alias("mode"))
    return show(logged, mode).unionByName(show(same, kept))


@query
def local_ids(spark, sf):
    """Peaks met by any candidate pair, each once; their candidates by the peak's own id on its time line."""
    spans = views.line_intervals(spark, sf)
    met = intervals.two_tier_candidates(views.order_anchors(spark, sf), spans, 5, 20)
    own = intervals.candidate_ids(met).join(spans.select("peak_id", (F.col("start") * 1000 + F.col("end")).alias("local_id")), "peak_id").filter("local_id % 10 <> 3")
    return intervals.to_local_ids(met.select("gene_id", "peak_id", "tier"), own).groupBy("local_id", "tier").agg(F.count(F.lit(1)).alias("pairs"))


@query
def module_names(spark, sf):
    """Module and its id from the path of an expression file; other paths give neither."""
    path = F.when(F.col("p_size") > 5, F.concat(F.lit("s3://b/x/module_"), F.col("p_brand"), F.lit("_expression.csv"))).otherwise(F.concat("p_type", F.lit("/other.csv")))
    named = views.table(spark, sf, "part").select(path.alias("path")).distinct().withColumn("module", text.module_of_path(F.col("path")))
    return named.select("path", "module", text.module_id(F.col("module")).alias("module_id"))


@query
def access_links(spark, sf):
    """The links behind gene activity: promoters with their distance, the kept distal peaks with score and rank."""
    genes = views.expression(spark, sf).select(F.col("gene").alias("gene_id")).distinct()
    anchors = genes.select("gene_id", F.lit("chr1").alias("chrom"), (F.col("gene_id") * 1000).cast("bigint").alias("pos"))
    peaks = genes.select(F.col("gene_id").alias("peak_id"), F.lit("chr1").alias("chrom"),
                         (F.col("gene_id") * 1000).cast("bigint").alias("start"), (F.col("gene_id") * 1000 + 400).cast("bigint").alias("end"))
    near = intervals.two_tier_candidates(anchors, peaks, 500, 6000)
    side = lambda name: views.expression(spark, sf).select(F.col("gene").alias(name), "cell_id", "value")
    _, links = intervals.gene_access_support(near, side("gene_id"), side("peak_id"), views.table(spark, sf, "embeddings").count(), 5)
    return links.select("gene_id", "peak_id", "link_kind", F.col("distance_to_anchor").alias("distance"), r6("link_score").alias("score"), F.col("retained_rank").cast("int").alias("retained_rank"))


@query
def separating_sets(spark, sf):
    """All sets of two and of three of the sizes that a brand comes in, in order."""
    pools = views.table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("pool"))
    sets = [skeleton.combinations_of(pools, "pool", k).select("p_brand", F.array_join(F.transform("zs", lambda z: z.cast("string")), ",").alias("members"), F.lit(k).alias("size")) for k in (2, 3)]
    return sets[0].unionByName(sets[1])
