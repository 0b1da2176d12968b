"""Networks of every cell of every module: one plan with the module as a key column."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RunConfig
from ..operators.normalize import open_scale
from ..operators import counts, graphs, neighborhoods, neighbors, orientation, priors, skeleton
from ..session import cut_lineage
from ..sources import files

SAFE = " !$&(),;<>@`|+"  # what partition folders leave as it is
GRAPHS, MANIFEST, NODE_VALUES = "graphs.parquet", "run_manifest.json", "node_values.parquet"


@dataclass(frozen=True)
class RunResult:
    graphs: DataFrame
    counters: DataFrame | None


def named_pairs(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs by name turned into gene ordinals a < b of each module."""
    known = lambda name, out: genes.select("module", F.col("name").alias(name), F.col("gene").alias(out))
    on = ["module"] if "module" in pairs.columns else []
    joined = pairs.withColumnsRenamed({"a": "_l", "b": "_r"}).join(known("_l", "x"), [*on, "_l"]).join(known("_r", "y"), ["module", "_r"])
    return joined.select("module", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")


def run_modules(expr: DataFrame, genes: DataFrame, config: RunConfig, pair_prior: DataFrame | None = None,
                target_prior: DataFrame | None = None, profiles: DataFrame | None = None, listed_modules: list[str] | None = None,
                profiled: DataFrame | None = None) -> RunResult:
    """Directed graphs (module, cell_id, n_genes, node_ptr, targets, topo_order, fallback, direct_edges) and counters by module.

    ``fallback`` marks a graph that no acyclic extension fits; ``direct_edges`` counts edges that the directed prior lists.

    ``pair_prior`` is (module, a, b, w) by name, ``target_prior`` the raw directed listing, ``profiles`` the second
    modality (module, cell_id, gene, value; zeros may be left out) of the genes in ``profiled`` (module, gene; those
    with a value if None).  In hard mode only ``listed_modules`` (all, if
    None) are restricted to their pairs; a module without a list keeps all of its own.
    """
    config.validate()
    alpha = config.significance_level
    joint = config.joint_mode == "joint_modality" and profiles is not None
    second = None
    if not joint:
        vectors = counts.cell_vectors(neighborhoods.cell_neighborhoods(expr, config.window_fraction))
    else:
        order = (profiles if profiled is None else profiled).select("module", "gene").distinct()
        vectors = counts.joint_vectors(expr, profiles, config.window_fraction, config.joint_open_threshold, order)
        second = order.groupBy("module").agg(F.array_sort(F.collect_list("gene")).alias("second"))
    forbidden = allowed = soft = motif = weights = None
    if pair_prior is not None:
        allowed = named_pairs(priors.strong_pairs(pair_prior, config.pair_min_strength, config.pair_weight_mode == "binary"), genes)
        if config.pair_prior_mode == "hard":
            restricted = genes if listed_modules is None else genes.filter(F.col("module").isin(listed_modules))
            forbidden = cut_lineage(priors.forbidden_pairs(restricted, allowed))
        else:
            soft = allowed
    if config.tf_prior_mode == "motif_prior":
        if target_prior is None:
            raise ValueError("tf_prior_mode='motif_prior' needs a target prior")
        listed = cut_lineage(priors.target_prior(target_prior, genes, config.tf_top_k))
        weights = priors.prior_weights(listed)
        per_cell = not listed.filter("trim(source) <> ''").isEmpty()
        motif = priors.undirected_strength(priors.activity_weights(listed, expr, genes) if per_cell else weights)
    levels = None
    if motif is not None or soft is not None:
        levels = priors.raised_levels(
            alpha, motif, soft, motif_alpha=config.tf_alpha, motif_min=config.tf_min_strength, gamma=config.tf_strength_gamma,
            cap=config.tf_max_conditioning_vars, pair_alpha=config.pair_alpha)
    found = cut_lineage(skeleton.skeletons(
        vectors, alpha, config.max_cond_vars, config.pc_variant == "stable", forbidden=forbidden, levels=levels,
        second=second, key_block=config.key_block))
    arcs = orientation.collider_edges(skeleton.skeleton_edges(found), skeleton.skeleton_sepsets(found))
    sizes = genes.groupBy("module").agg(F.count(F.lit(1)).cast("int").alias("n_genes"))
    nodes = found.select("module", "cell_id").join(sizes, "module").select("module", "cell_id", "n_genes")
    # The fourth rule belongs to modules in which pairs remain forbidden.
    fourth = False if forbidden is None else frozenset(r["module"] for r in forbidden.select("module").distinct().toLocalIterator())
    directed = cut_lineage(orientation.directed_graphs(arcs, nodes, fourth))
    edges = directed.select("module", "cell_id", F.inline("edges"))
    counters = [sizes.select("module")]
    per_module = lambda df, name: df.groupBy("module").agg(F.count(F.lit(1)).alias(name))
    if allowed is not None:
        counters.append(per_module(allowed, "listed_pairs"))
    if joint:
        counters.append(per_module(order, "profiled_genes"))
    marks = directed.select("module", "cell_id", "fallback")
    if weights is not None:
        oriented = orientation.orient_by_prior(edges, weights)
        counters += [orientation.orientation_totals(oriented), per_module(weights, "supported_pairs")]
        edges = oriented.select("module", "cell_id", "src", "dst")
        direct = graphs.edges_in(edges, weights).groupBy("module", "cell_id").agg(F.count(F.lit(1)).alias("direct_edges"))
        marks = marks.join(direct, ["module", "cell_id"], "left").withColumn("direct_edges", F.coalesce("direct_edges", F.lit(0)))
    packed = graphs.topological_orders(graphs.pack_graphs(edges, nodes)).join(marks, ["module", "cell_id"])
    return RunResult(packed, reduce(lambda x, y: x.join(y, "module", "left"), counters))


def finished_modules(spark: SparkSession, result_dir: str, modules) -> set[str]:
    """Modules with both a result and a manifest."""
    return {m for m in modules if m in written_modules(spark, f"{result_dir}/{GRAPHS}") and files.exists(spark, f"{result_dir}/{m}/{MANIFEST}")}


def written_modules(spark: SparkSession, path: str) -> set[str]:
    """Modules that have a partition in a table of results."""
    return {unquote(n.partition("=")[2]) for n in files.names_in(spark, path, "module=*")}


def read_by_module(spark: SparkSession, path: str, modules: list[str]) -> DataFrame:
    """The partitions of some modules, the module as a string."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/module={quote(m, safe=SAFE)}" for m in modules]).withColumn("module", F.col("module").cast("string"))


def _write_by_module(df: DataFrame, path: str) -> None:
    """One job for all modules; only their own partitions are replaced. Rows of one module may come from many tasks."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def joint_profiles(spark: SparkSession, module_dir: str, genes: DataFrame, cells: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Second-modality profiles (module, cell_id, gene, value), zeros left out, and the genes that have one (module, gene).

    Links come from gene_peak_links.csv, access from the table and barcode list that the preprocess manifest names.  A
    cell that the list lacks is an error; one that is listed without counts holds 0.  A gene has a profile if one of its
    peaks is known, with or without counts.
    """
    links = spark.read.csv(f"{module_dir}/gene_peak_links.csv", header=True, inferSchema=True)
    usable = cut_lineage(priors.usable_links(links, genes))
    raw, known, barcodes = files.read_access(spark, module_dir)
    missing = cells.join(barcodes, "barcode", "left_anti")
    few = [r["barcode"] for r in missing.orderBy("barcode").limit(5).collect()]
    if few:
        raise ValueError(f"{missing.count()} cells are not in the access table, such as {', '.join(few)}")
    asked = usable.select("peak_name").distinct()
    wanted = raw.filter("count > 0").join(asked, "peak_name", "left_semi").join(cells, "barcode")
    access = open_scale(wanted, "peak_name").select("peak_name", "cell_id", "access")
    profiled = usable.join(known, "peak_name", "left_semi").select("module", "gene").distinct()
    return priors.gene_profiles(usable, access, config.joint_profile_mode, config.joint_open_threshold).filter("value <> 0"), profiled


def factor_nodes(expr: DataFrame, genes: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Replace the genes of wide modules by non-negative factors, where the options ask for it."""
    sizes = {r["module"]: r["n"] for r in genes.groupBy("module").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    reduced = {m: min(n, config.nmf_components) for m, n in sizes.items() if config.uses_factors(n)}
    if reduced and config.tf_prior_mode != "none":
        raise ValueError("a motif prior cannot be combined with factors")
    kept = F.col("module").isin(list(reduced))
    nodes, names = expr.filter(~kept), genes.filter(~kept)
    for module, k in reduced.items():
        cells, _ = neighbors.nonnegative_factors(expr.filter(F.col("module") == module), k, config.nmf_max_iter)
        nodes = nodes.unionByName(cells.select(
            F.lit(module).alias("module"), F.col("cell_id").cast("bigint").alias("cell_id"), F.posexplode("v").alias("gene", "value")))
        names = names.unionByName(genes.sparkSession.range(k).select(
            F.lit(module).alias("module"), F.col("id").cast("int").alias("gene"), F.format_string("factor_%03d", F.col("id")).alias("name")))
    return nodes, names, reduced


def run_directory(spark: SparkSession, module_dir: str, result_dir: str, config: RunConfig, only: str | None = None) -> dict[str, dict]:
    """Run the modules of a folder that have no result yet; returns each module's manifest."""
    config.validate()
    listed = files.module_files(spark, module_dir)
    if only:
        listed = {only: listed[only]}
    finished = finished_modules(spark, result_dir, listed)
    pending = {m: p for m, p in listed.items() if m not in finished}
    if pending:
        expr, genes, cells = files.read_modules(spark, pending)
        raw_pairs = files.read_side_files(spark, pending, "_allowed_pairs.csv") if config.use_pair_prior else None
        pairs = None if raw_pairs is None else priors.pair_prior(raw_pairs, ["module"])
        targets = None
        if config.tf_prior_mode != "none":
            targets = files.read_side_files(spark, pending, "_tf_target_prior.csv")
            if targets is None:
                raise FileNotFoundError("no _tf_target_prior.csv next to the modules")
        profiles, profiled = joint_profiles(spark, module_dir, genes, cells, config) if config.joint_mode != "none" else (None, None)
        expr, genes, reduced = factor_nodes(cut_lineage(expr), genes, config)
        expr = cut_lineage(expr) if reduced else expr
        with_list = [m for m in files.with_side_file(spark, pending, "_allowed_pairs.csv") if m not in reduced]
        done = run_modules(expr, genes, config, pairs, targets, profiles, with_list, profiled)
        result = cut_lineage(done.graphs.join(cells, "cell_id"))
        facts = {r["module"]: r.asDict() for r in result.groupBy("module").agg(
            F.count(F.lit(1)).alias("cell_count"), F.first("n_genes").alias("node_count"), F.sum(F.size("targets")).alias("edge_count"),
            F.sum((F.get("topo_order", F.lit(0)) < 0).cast("int")).alias("cyclic_count"), F.count_if("fallback").alias("fallback_count"),
            *[F.sum("direct_edges").alias("direct_edge_count")] * ("direct_edges" in result.columns)).toLocalIterator()}
        totals = {r["module"]: r.asDict() for r in done.counters.toLocalIterator()}
        names = {m: [] for m in pending}
        for r in genes.orderBy("module", "gene").toLocalIterator():
            names[r["module"]].append(r["name"])
        _write_by_module(result, f"{result_dir}/{GRAPHS}")
        if reduced:
            _write_by_module(expr.filter(F.col("module").isin(list(reduced))).join(cells, "cell_id").select("module", "barcode", "gene", "value"), f"{result_dir}/{NODE_VALUES}")
        for module in pending:
            files.write_json(spark, f"{result_dir}/{module}/{MANIFEST}", {
                "module_name": module, "use_nmf_applied": module in reduced, "node_names": names[module], **facts.get(module, {}), **totals.get(module, {}), **asdict(config)})
    return {m: json.loads(files.read_text(spark, f"{result_dir}/{m}/{MANIFEST}")) for m in listed}
