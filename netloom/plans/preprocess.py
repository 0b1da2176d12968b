"""From raw matrices to gene modules and their priors."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import PreprocessConfig
from ..functions.text import canonical_token, parse_interval
from ..operators import features, intervals, modules, motifs, normalize
from ..session import cut_lineage
from ..sources import files


def _modules(expr: DataFrame, n_genes: int, config: PreprocessConfig, cells: DataFrame | None = None) -> DataFrame:
    """Modules of the genes; with ``cells``, entries that ``expr`` lacks are 0 in each of them."""
    cov = modules.covariances(expr, n_genes) if cells is None else modules.sparse_covariances(expr, n_genes, cells.count())
    found = modules.gene_modules(cov, config.soft_power, config.cut_height, config.module_min_size, config.module_max_size)
    return cut_lineage(found.withColumn("module_id", modules.module_label()))


def _export(spark, out: str, expr: DataFrame, genes: DataFrame, cells: DataFrame, membership: DataFrame, config: PreprocessConfig,
            manifest: dict, tables: dict[str, DataFrame], priors_by_module: DataFrame | None = None) -> dict:
    """Write the bundle: a wide CSV per module, mappings, tables and the manifest."""
    named = membership.join(genes, "gene").select(
        F.col("name").alias("gene"), F.col("gene_id"), "module_id", "order_in_module", F.lit(config.input_modality).alias("input_modality"),
        F.lit(config.analysis_mode).alias("analysis_mode"), F.col("gene_symbol"), F.col("gene").alias("ordinal"))
    rows = named.orderBy("module_id", "order_in_module").collect()  # one row per gene, at most the selected genes
    by_module: dict[str, list] = {}
    for r in rows:
        by_module.setdefault(r["module_id"], []).append(r)
    labelled = expr.join(cells, "cell_id").join(genes.select("gene", "name"), "gene").select("barcode", "gene", "name", "value")
    for module, members in by_module.items():
        part = labelled.filter(F.col("gene").isin([r["ordinal"] for r in members]))
        wide = cells.select("barcode").join(part.groupBy("barcode").pivot("name", [r["gene"] for r in members]).agg(F.first("value")), "barcode", "left").fillna(0.0)
        wide.coalesce(1).write.mode("overwrite").csv(f"{out}/module_{module}_expression.csv", header=True)
        if priors_by_module is not None:
            files.write_csv(priors_by_module.filter(F.col("module_id") == module), f"{out}/module_{module}_expression_tf_target_prior.csv")
    if config.analysis_mode == "representation":
        names = [r["name"] for r in genes.orderBy("gene").select("name").toLocalIterator()]
        files.write_csv(cells.select("barcode").join(labelled.groupBy("barcode").pivot("name", names).agg(F.first("value")), "barcode", "left").fillna(0.0), f"{out}/{config.prefix}_representation_input.csv")
    files.write_csv(named.drop("ordinal", "gene_symbol"), f"{out}/gene_module_mapping.csv")
    files.write_csv(named.select("module_id", F.col("gene").alias("module_column"), "gene_id", "gene_symbol", "order_in_module"), f"{out}/gene_alias_mapping.csv")
    sizes = membership.groupBy("module_id").agg(F.count(F.lit(1)).alias("gene_count"))
    files.write_csv(sizes, f"{out}/module_metadata.csv")
    for name, table in tables.items():
        files.write_csv(table, f"{out}/{name}.csv")
    summary = features.module_summary(membership, "module_id").first().asDict()
    manifest = {**asdict(config), **manifest, "modules": summary}
    files.write_json(spark, f"{out}/sensitivity_report.json", [{"setting": "wgcna_default", **summary}])
    files.write_json(spark, f"{out}/preprocess_manifest.json", manifest)
    return manifest


def prepare_expression(spark: SparkSession, config: PreprocessConfig, out: str) -> dict:
    """A cells x genes CSV: log-normalised if it looks like counts, then cut into modules."""
    long, names = files.wide_csv(spark, config.input_path)
    cells = files.number_cells(spark, [config.input_path])
    genes = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "gene int, name string").withColumns(
        {"gene_id": F.col("name"), "gene_symbol": F.col("name")})
    raw = cut_lineage(long.join(cells, "barcode").join(genes.select("gene", "name"), "name").select(
        F.lit("all").alias("module"), "cell_id", "gene", "value"))
    expr, mode = normalize.auto_log(raw)
    membership = _modules(expr, len(names), config)
    return _export(spark, out, expr, genes, cells, membership, config,
                   {"normalization_mode": mode, "selected_shape": [cells.count(), len(names)]}, {})


def prepare_multiome(spark: SparkSession, config: PreprocessConfig, out: str) -> dict:
    """Paired expression and access counts: selection, modules, peak links and optional motif priors."""
    counts, listed, barcodes = files.read_coordinates(spark, config.input_path)
    n_all = barcodes.count()
    rna = features.of_type(counts, listed, "Gene Expression")
    peaks = features.of_type(counts, listed, "Peaks")
    logged = cut_lineage(normalize.log_normalize(rna))
    chosen = features.require_features(cut_lineage(features.top_variable(logged, n_all, config.top_genes, config.min_gene_cells, "value")))
    totals = barcodes.select("cell_id").join(normalize.library_sizes(rna), "cell_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    kept = None if config.top_cells >= n_all else config.top_cells
    cells = cut_lineage(features.top_cells(totals, kept).select("cell_id").join(barcodes, "cell_id"))
    n_cells = cells.count()
    peaks = peaks.join(cells.select("cell_id"), "cell_id", "left_semi")
    top_peaks = features.require_features(cut_lineage(features.top_variable(peaks, n_cells, config.top_peaks, config.min_peak_cells)))
    aliases = spark.createDataFrame([], "alias string, symbol string")
    starts = spark.createDataFrame([], "key string, chrom string, pos bigint")
    if config.gtf:
        starts, aliases = files.read_annotation(spark, config.gtf)
    own = listed.join(chosen.select("feature_id", "variance"), "feature_id").withColumnRenamed("feature_id", "_id").withColumnRenamed("gene_id", "feature_id")
    placed = intervals.resolve_symbols(intervals.resolve_anchors(own, starts), aliases)
    ordered = features.order_in_group(placed.withColumn("_g", F.lit(1)), ["_g"], "_id", "gene").withColumn("gene", (F.col("gene") - 1).cast("int"))
    genes = cut_lineage(features.unique_names(ordered, order="gene").select(
        "gene", "_id", F.col("unique_name").alias("name"), F.col("feature_id").alias("gene_id"), "gene_symbol", "anchor", "anchor_source"))
    n_genes = genes.count()
    # Zeros are not stored: covariances fill vectors, the bundle fills rows, ranks count the zero block.
    expr = cut_lineage(logged.join(genes.select(F.col("_id").alias("feature_id"), "gene"), "feature_id").join(cells.select("cell_id"), "cell_id").select(
        F.lit("all").alias("module"), "cell_id", "gene", "value"))
    membership = _modules(expr, n_genes, config, cells)
    where = parse_interval(F.col("interval"))
    spots = listed.join(top_peaks.select("feature_id"), "feature_id").select(
        F.col("feature_id").alias("peak_id"), F.col("name").alias("peak_name"), where.alias("w")).filter("w is not null").select("peak_id", "peak_name", "w.*")
    access = cut_lineage(peaks.join(top_peaks.select("feature_id"), "feature_id", "left_semi").select(
        F.col("feature_id").alias("peak_id"), "cell_id", F.col("count").cast("double").alias("value")))
    found = cut_lineage(intervals.peak_gene_links(
        genes.select(F.col("gene").alias("gene_id"), "anchor", "anchor_source", "gene_symbol", "name", F.col("gene_id").alias("gene_gene_id")),
        spots, expr.select(F.col("gene").alias("gene_id"), "cell_id", "value"), access, n_cells, config.peak_gene_window, config.peak_gene_corr_threshold))
    links = found.select(F.col("name").alias("gene_module_column"), "gene_gene_id", "gene_symbol", "peak_name", "peak_interval", "peak_gene_corr",
                         "distance_to_tss", "peak_accessibility_median", "association_pass", "anchor_source")
    tables, by_module, facts = {"gene_peak_links": links}, None, {}
    if config.enable_motif_prior:
        triplets = cut_lineage(_motif_triplets(spark, config, genes, membership, links, spots, aliases))
        by_module = cut_lineage(motifs.best_triplets(triplets))
        tables["tf_peak_gene_triplets"] = triplets
        facts = {"motif_triplet_count": triplets.count(), "motif_target_pair_count": by_module.count(),
                 "motif_symbol_count": by_module.select("tf_symbol").distinct().count()}
    named = listed.select("feature_id", F.col("name").alias("peak_name"))
    selected = features.of_type(counts, listed, "Peaks").join(top_peaks.select("feature_id"), "feature_id", "left_semi")
    facts |= files.write_access(selected.join(named, "feature_id").join(barcodes, "cell_id"), named.join(top_peaks.select("feature_id"), "feature_id", "left_semi"), barcodes, out)
    hist = {r["anchor_source"]: r["genes"] for r in intervals.anchor_histogram(genes).collect()}  # at most three labels
    manifest = {"selected_shape": [n_cells, n_genes], "top_peaks_selected": top_peaks.count(), "anchor_source_counts": hist,
                "peak_gene_link_count": links.count(), **facts}
    return _export(spark, out, expr, genes, cells, membership, config, manifest, tables, by_module)


def _motif_triplets(spark, config, genes, membership, links, spots, aliases) -> DataFrame:
    own = genes.select(canonical_token(F.col("gene_symbol")).alias("tf_symbol")).filter("tf_symbol <> ''").distinct()
    if config.tf_list:
        allowed = files.read_regulators(spark, config.tf_list, aliases)
        own = own if allowed.isEmpty() else own.join(allowed, "tf_symbol", "left_semi")
    catalogue = motifs.log_odds(motifs.motifs_by_symbol(files.read_motifs(spark, config.motif_file), own))
    wanted = spots.join(links.select("peak_name").distinct(), "peak_name", "left_semi")
    hits = motifs.scan_sequences(files.read_sequences(spark, config.genome_fasta, wanted), catalogue)
    members = membership.join(genes, "gene").select(F.col("module_id").alias("module"), F.col("name").alias("module_column"), "gene_id", "gene_symbol")
    inside = links.join(members.select("module", F.col("module_column").alias("gene_module_column")), "gene_module_column") \
        .withColumnRenamed("peak_accessibility_median", "peak_median").drop("gene_gene_id")
    return motifs.triplets(inside, hits, members)


def build_modules(spark: SparkSession, config: PreprocessConfig, out: str) -> dict:
    config.validate()
    return (prepare_expression if config.input_modality == "scrna" else prepare_multiome)(spark, config, out)
