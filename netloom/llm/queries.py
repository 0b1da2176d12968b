"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprints, langid, linededup, maintext, ngramjoin, packing, spelling, substrings, toxicity, vectorcodes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op9_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return langid.predict(docs, langid.train(docs))


@query
def op5_line_dedup(spark, sf):
    return linededup.line_report(table(spark, sf, "documents"))


@query
def op3_ngram_jaccard_join(spark, sf):
    return ngramjoin.link_report(table(spark, sf, "documents"))


@query
def op2_decontamination(spark, sf):
    return decontam.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_best_fit_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


@query
def op1_document_fingerprints(spark, sf):
    return fingerprints.fingerprint_report(table(spark, sf, "documents"))


@query
def op10_html_extraction(spark, sf):
    return maintext.extract(table(spark, sf, "pages"))


@query
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model, _ = toxicity.train(docs, table(spark, sf, "labels"))
    return toxicity.scored(docs, model)


@query
def op6_chat_formatting(spark, sf):
    return chat.formatted(table(spark, sf, "conversations"))


@query
def op4_substring_dedup(spark, sf):
    return substrings.without_repeats(table(spark, sf, "documents"), texts=False)


@query
def op11_spelling_variants(spark, sf):
    return spelling.spelling_report(table(spark, sf, "documents"))


@query
def op12_vector_codes(spark, sf):
    return vectorcodes.code_report(table(spark, sf, "embeddings"))


@query
def op13_warc(spark, sf):
    return warc.archive_report(table(spark, sf, "pages"))
