"""Readers for matrices, annotations, motifs and sequences, and the writers of results."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import attribute_map, canonical_token, motif_tokens, strip_version
from ..operators.ranks import running_total
from ..session import cut_lineage
from . import coordinates

SEQUENCE_BIN = 4096


def _open_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.text(path).first()
    columns = header["value"].count(",") + 2 if header else 2  # the reader stops at 20,480 unless told
    return spark.read.csv(path, header=True, maxColumns=columns, maxCharsPerColumn=-1)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def number_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(barcode, cell_id): barcodes of expression files numbered from 0 in file and line order, whatever the partitions.

    Lines are counted inside file blocks and over the blocks before; a checkpoint fixes the numbers.
    """
    parts = []
    for i, path in enumerate(paths):
        wide = _open_csv(spark, path)
        block = F.struct(F.lit(i).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        parts.append(wide.select(F.col(_quoted(wide.columns[0])).alias("barcode"), block.alias("_block"), F.monotonically_increasing_id().alias("_at")))
    first = reduce(DataFrame.unionByName, parts).groupBy("barcode").agg(F.min(F.struct("_block", "_at")).alias("_first"))
    placed = first.select(F.lit(0).alias("_all"), "barcode", "_first._block", "_first._at")
    numbered = running_total(placed, ["_all"], "_block", [F.col("_at")], F.lit(1), "cell_id")
    return cut_lineage(numbered.select("barcode", F.col("cell_id").cast("bigint").alias("cell_id")))


def wide_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(barcode, gene name, value) of one expression file and its genes in file order."""
    wide = _open_csv(spark, path)
    first, *genes = wide.columns
    named = wide.select(F.col(_quoted(first)).alias("barcode"), *[F.col(_quoted(g)).cast("float").cast("double").alias(g) for g in genes])
    return named.unpivot("barcode", [_quoted(g) for g in genes], "name", "value"), genes


def module_files(spark: SparkSession, folder: str) -> dict[str, str]:
    found = {n.removesuffix(".csv"): f"{folder}/{n}" for n in names_in(spark, folder, "module_*_expression.csv")}
    if not found:
        raise ValueError(f"no module expression files in {folder}")
    return found


def read_modules(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long expression (module, cell_id, gene, value), genes (module, gene, name) and cells (barcode, cell_id)."""
    parts, genes = [], []
    for module, path in files.items():
        long, names = wide_csv(spark, path)
        parts.append(long.withColumn("module", F.lit(module)))
        genes += [(module, i, n) for i, n in enumerate(names)]
    every = reduce(DataFrame.unionByName, parts)
    cells = number_cells(spark, list(files.values()))
    listed = spark.createDataFrame(genes, "module string, gene int, name string")
    expr = every.join(cells, "barcode").join(listed, ["module", "name"]).select("module", "cell_id", "gene", "value")
    return expr, listed, cells


def _side(files: dict[str, str], module: str, ending: str) -> str:
    folder, _, _ = files[module].rpartition("/")
    return f"{folder or '.'}/{module}{ending}"


def with_side_file(spark: SparkSession, files: dict[str, str], ending: str) -> list[str]:
    """Modules that have a ``<module><ending>`` file."""
    return [m for m in files if exists(spark, _side(files, m, ending))]


def read_side_files(spark: SparkSession, files: dict[str, str], ending: str) -> DataFrame | None:
    """The ``<module><ending>`` files next to the modules, as one frame with ``module``; None if there are none."""
    parts = []
    for module in with_side_file(spark, files, ending):
        parts.append(spark.read.csv(_side(files, module, ending), header=True, inferSchema=True).withColumn("module", F.lit(module)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_coordinates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sparse counts (cell_id, feature_id, count), features and barcodes.

    ``folder`` holds counts.parquet, features.parquet (feature_id, name, gene_id, feature_type, interval, ordinal)
    and barcodes.parquet (cell_id, barcode), or a matrix folder as ``coordinates`` reads it.
    """
    if exists(spark, f"{folder}/counts.parquet"):
        return tuple(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("counts", "features", "barcodes"))
    counts, features, barcodes = (coordinates.read_table(spark, folder, t) for t in ("counts", "features", "barcodes"))
    return counts.drop("feature_type"), features, barcodes


def read_annotation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Start sites (key, chrom, pos) and aliases (alias, symbol) of an annotation; the last row of a key wins."""
    lines = spark.read.csv(path, sep="\t", comment="#", quote="", schema=", ".join(f"f{i} string" for i in range(9)))
    genes = lines.filter("f2 = 'gene' and f8 is not null").select(
        F.col("f0").alias("chrom"), F.when(F.col("f6") == "+", F.col("f3")).otherwise(F.col("f4")).cast("bigint").alias("pos"),
        attribute_map(F.col("f8")).alias("m"), F.monotonically_increasing_id().alias("at"))
    name, ident = F.col("m")["gene_name"], F.col("m")["gene_id"]
    keyed = genes.withColumn("keys", F.array_distinct(F.array_compact(F.array(name, ident, strip_version(ident))))).withColumn(
        "symbol", F.coalesce(F.when(name != "", name), ident))
    starts = keyed.select(F.explode("keys").alias("key"), "chrom", "pos", "at").filter("key <> ''").groupBy("key").agg(
        F.max_by(F.struct("chrom", "pos"), "at").alias("s")).select("key", "s.*")
    aliases = keyed.filter("symbol is not null").select(F.explode("keys").alias("k"), "symbol", "at").select(
        canonical_token(F.col("k")).alias("alias"), "symbol", "at").filter("alias <> ''").groupBy("alias").agg(F.max_by("symbol", "at").alias("symbol"))
    return starts, aliases


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Count matrices of a PFM catalogue: ordinal, motif_id, motif_name, tokens, counts (positions x ACGT)."""
    blocks = spark.read.text(path, lineSep=">").filter("trim(value) <> ''").withColumn("ordinal", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    row = lambda letter: F.transform(
        F.regexp_extract_all(F.regexp_extract("value", rf"(?m)^\s*{letter}\s*\[?([^\]\n]*)", 1), F.lit(r"([0-9.]+)"), 1), lambda x: x.cast("double"))
    ident = F.regexp_extract(head, r"^(\S+)", 1)
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(head, r"^\S+\s+(.*)$", 1)), F.lit("")), ident)
    rows = blocks.select("ordinal", ident.alias("motif_id"), name.alias("motif_name"), *[row(c).alias(c) for c in "ACGT"])
    counts = F.transform(F.arrays_zip("A", "C", "G", "T"), lambda p: F.array(p["A"], p["C"], p["G"], p["T"]))
    return rows.select("ordinal", "motif_id", "motif_name", motif_tokens(F.col("motif_name")).alias("tokens"), counts.alias("counts"))


def read_regulators(spark: SparkSession, path: str, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct canonical tokens of a list (first tab field, # comments), mapped to symbols if aliases are given."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and v not like '#%'")
    tokens = lines.select(canonical_token(F.substring_index("v", "\t", 1)).alias("alias")).filter("alias <> ''").distinct()
    if aliases is None:
        return tokens.withColumnRenamed("alias", "tf_symbol")
    return tokens.join(aliases, "alias").select(canonical_token(F.col("symbol")).alias("tf_symbol")).distinct()


def read_sequences(spark: SparkSession, path: str, peaks: DataFrame, bin_size: int = SEQUENCE_BIN) -> DataFrame:
    """Upper-case sequence of each peak (peak_name, chrom, start, end; 1-based start) from a FASTA file.

    Lines get their offset by a running length in two steps, inside a file block and over the blocks, so no
    chromosome is ever one row.  A chromosome may be named with or without ``chr``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("v"))
    inside = W.partitionBy("block").orderBy("at")
    marked = lines.withColumn("head", F.when(F.col("v").startswith(">"), F.regexp_extract("v", r"^>(\S+)", 1))) \
        .withColumn("no", F.count("head").over(inside)).withColumn("len", F.when(F.col("head").isNull(), F.length("v")).otherwise(0)) \
        .withColumn("off", F.sum("len").over(W.partitionBy("block", "no").orderBy("at").rowsBetween(W.unboundedPreceding, -1)))
    # Carry over block borders: one row per (block, contig piece), a few per block.
    pieces = marked.groupBy("block", "no").agg(F.max("head").alias("head"), F.sum("len").alias("len"))
    order = W.orderBy("block", "no")
    pieces = pieces.withColumn("contig", F.last("head", ignorenulls=True).over(order))
    pieces = pieces.withColumn("base", F.coalesce(F.sum("len").over(
        W.partitionBy("contig").orderBy("block", "no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("block", "no", "contig", "base")
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    text = marked.filter("len > 0").join(pieces, ["block", "no"]).select(
        bare(F.col("contig")).alias("c"), F.upper("v").alias("v"), (F.col("base") + F.coalesce("off", F.lit(0))).alias("from"))
    text = text.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / bin_size), F.floor((F.col("from") + F.length("v") - 1) / bin_size))))
    start = F.greatest(F.col("start") - 1, F.lit(0))
    asked = peaks.select("peak_name", bare(F.col("chrom")).alias("c"), start.alias("s"), F.greatest("end", start + 1).alias("e")).withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor((F.col("e") - 1) / bin_size))))
    met = asked.join(text, ["c", "bin"]).filter("`from` < e and `from` + length(v) > s").select("peak_name", "s", "e", "from", "v").distinct()
    piece = F.substr("v", F.greatest(F.col("s") - F.col("from"), F.lit(0)).cast("int") + 1,
                     (F.least("e", F.col("from") + F.length("v")) - F.greatest("s", "from")).cast("int"))
    return met.groupBy("peak_name").agg(F.array_sort(F.collect_list(F.struct("from", piece.alias("p")))).alias("g")).select(
        "peak_name", F.array_join("g.p", "").alias("sequence"))


ACCESS, ACCESS_PEAKS, ACCESS_BARCODES = "peak_access.parquet", "peak_access_peaks.parquet", "peak_access_barcodes.parquet"


def write_access(entries: DataFrame, peaks: DataFrame, barcodes: DataFrame, out: str) -> dict[str, str]:
    """Access counts (peak_name, barcode, count) clustered by peak, the peaks and the barcodes; returns the manifest's entries.

    Rows of one peak range lie together and in order, so a filter on peak names skips files and row groups.
    """
    entries.select("peak_name", "barcode", F.col("count").cast("double").alias("count")).repartitionByRange("peak_name", "barcode") \
        .sortWithinPartitions("peak_name", "barcode").write.mode("overwrite").parquet(f"{out}/{ACCESS}")
    peaks.select("peak_name").distinct().write.mode("overwrite").parquet(f"{out}/{ACCESS_PEAKS}")
    barcodes.select("barcode").distinct().write.mode("overwrite").parquet(f"{out}/{ACCESS_BARCODES}")
    return {"access_table": ACCESS, "access_peaks": ACCESS_PEAKS, "access_barcodes": ACCESS_BARCODES}


def resolve(spark: SparkSession, folder: str, value: str | None) -> str:
    """A path named by a manifest: as it stands, else relative to the manifest's folder."""
    if not value:
        raise ValueError(f"the manifest in {folder} does not name the path")
    relative = not re.match(r"([a-z0-9+]+:)?/", value)
    for candidate in [value, f"{folder}/{value}"][1 if relative and not exists(spark, value) else 0 :]:
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(value)


def read_access(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(peak_name, barcode, count), the known peaks and the known barcodes of a bundle, by way of its manifest."""
    manifest = json.loads(read_text(spark, f"{folder}/preprocess_manifest.json"))
    return tuple(spark.read.parquet(resolve(spark, folder, manifest.get(name))) for name in ("access_table", "access_peaks", "access_barcodes"))


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, whichever store it names, and the path itself."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Sorted names of the entries of a folder that fit a glob pattern."""
    fs, at = _hadoop(spark, f"{folder}/{pattern}")
    found = fs.globStatus(at)
    return sorted(s.getPath().getName() for s in found) if found else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _hadoop(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, payload) -> None:
    write_text(spark, path, json.dumps(payload, indent=2))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
