"""Corpus preparation: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontam, langid, linededup, ngramjoin, packing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or that no learned language claims, go."""
    return langid.keep_known(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share; such a line stays where it stands first."""
    return linededup.drop_boilerplate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return ngramjoin.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in training sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("decontamination", benchmark), ("best_fit_packing", sequences)]
ORACLE_SQL: str | None = None  # trained weights and greedy packing have no SQL form; tests compare with brute force


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under the one that spark.checkpoint.dir names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="corpus-pipeline-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
