"""Views over the star-schema tables that stand in for expression, access, priors and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Letters mapped onto the four bases, case by case.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGT" * 6 + "AC"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def expression(spark: SparkSession, folder: str, relu: bool = True, by_label: bool = False) -> DataFrame:
    """Every embedding dimension as a gene, every vector as a cell."""
    raw = table(spark, folder, "embeddings")
    module = F.concat(F.lit("L"), F.col("label").cast("string")) if by_label else F.lit("all")
    long = raw.select(module.alias("module"), F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("gene", "_v"))
    value = F.col("_v").cast("double")
    return long.select("module", "cell_id", "gene", (F.greatest(value, F.lit(0.0)) if relu else value).alias("value"))


def tied_values(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity, discount and tax of every line: three heavily tied genes."""
    names = ("l_quantity", "l_discount", "l_tax")
    entries = [F.struct(F.lit(i).alias("gene"), F.col(c).alias("value")) for i, c in enumerate(names)]
    return table(spark, folder, "lineitem").select(F.lit("all").alias("module"), F.inline(F.array(*entries)))


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user and type: cells x features counts."""
    return table(spark, folder, "events").groupBy(
        F.col("user_id").alias("cell_id"), F.col("event_type").alias("feature_id")
    ).agg(F.count(F.lit(1)).alias("count"))


def part_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity sold per supplier and part: a sparse cells x features matrix."""
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")
    ).agg(F.sum("l_quantity").alias("count"))


def day_number(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1995-01-01")).cast("bigint")


def order_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as anchors on their customer's time line."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("gene_id"), F.col("o_custkey").cast("string").alias("chrom"), day_number("o_orderdate").alias("pos"))


def line_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as intervals from ship date on, as long as their quantity, on the same time lines."""
    line = table(spark, folder, "lineitem")
    order = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    start = day_number("l_shipdate")
    return (
        line.join(order, line["l_orderkey"] == order["o_orderkey"])
        .groupBy("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey", "l_partkey", "l_suppkey", "l_quantity")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), start).alias("peak_id"),
            F.col("o_custkey").cast("string").alias("chrom"), start.alias("start"),
            (start + F.col("l_quantity").cast("bigint")).alias("end"))
    )


def listed_priors(spark: SparkSession, folder: str) -> DataFrame:
    """Part brands regulating part types, scored by their parts' price share."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_brand").alias("tf_module_column"), F.col("p_type").alias("gene_module_column"),
        (F.col("p_size") / 50.0).alias("tf_target_score"))


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as nucleotide sequences."""
    mapped = F.translate(F.col("text"), LETTERS + LETTERS.lower(), BASES + BASES)
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("peak_name"), "lang", mapped.alias("sequence"))
