"""Cross-site boilerplate lines: how many distinct sites show a line, by HyperLogLog sketches, decides whether it goes.

DataFrame functions only. One sketch of sites per line hash is built before and merged after the shuffle, so a line that
a third of all documents share costs one small row per task. Lines whose estimate lies near the threshold get exact
distinct counts; the others are decided by the estimate. A boilerplate line stays where it stands first (smallest
doc_id, then first line) and goes everywhere else.

Lines are split at ``\\n`` and compared without outer spaces, tabs and carriage returns; blank lines are never boilerplate
and always stay. Defined results: a null text has no lines and stays null; a text whose lines all go becomes empty.
A null site is no site. A null doc_id sorts first. Rows that repeat an id are told apart by their text, and equal rows
are treated alike. Extra columns are passed through by ``drop_boilerplate``; only text and n_chars change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\r"
SKETCH_BITS = 12
SPREAD = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)  # four standard errors of the sketch
KEY = ["__h1", "__h2"]
ROW = ["__id", "__text_hash"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: row key, site, position, 128-bit hash."""
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"), F.col("source").cast("string").alias("__site"),
                       F.posexplode(_lines(F.col("text"))).alias("__pos", "__line"))
    line = F.btrim("__line", F.lit(BLANKS))
    return (rows.withColumn("__line", line).where(F.length("__line") > 0)
            .select(*ROW, "__site", "__pos", F.xxhash64("__line").alias(KEY[0]), F.xxhash64(F.lit("second"), "__line").alias(KEY[1])))


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes that at least ``min_sites`` distinct sites show, with their first place."""
    sketches = rows.groupBy(*KEY).agg(F.hll_sketch_agg("__site", SKETCH_BITS).alias("sketch"), F.min(F.struct("__id", "__pos", "__text_hash")).alias("first"))
    found = sketches.select(*KEY, "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - SPREAD) - 1)
    near = F.col("sites") <= min_sites * (1 + SPREAD) + 1
    exact = (rows.join(found.where(near).select(*KEY), KEY, "left_semi").select(*KEY, "__site").distinct()
             .groupBy(*KEY).agg(F.count("__site").alias("exact")).where(F.col("exact") >= min_sites))
    return found.where(~near).select(*KEY, "first").unionByName(found.where(near).join(exact, KEY, "left_semi").select(*KEY, "first"))


def removals(docs: DataFrame, min_sites: int) -> DataFrame:
    """Sorted positions of the lines to remove, for each row that has any."""
    rows = line_rows(docs)
    hits = rows.join(boilerplate(rows, min_sites), KEY).where(~F.struct("__id", "__pos", "__text_hash").eqNullSafe(F.col("first")))
    return hits.groupBy(*ROW).agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions, in time linear in its lines: the stretches between them are joined."""
    def stretches(lines: Column) -> Column:
        ends = F.array_append(gone, F.size(lines))
        return F.flatten(F.transform(ends, lambda end, i: F.slice(lines, _before(gone, i) + 2, end - _before(gone, i) - 1)))

    return F.array_join(F.transform(F.array(_lines(text)), stretches)[0], "\n")


def _before(gone: Column, i: Column) -> Column:
    return F.coalesce(F.get(gone, i - 1), F.lit(-1))


def dedup_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """Each input row with its remaining text in ``__kept`` and the removed positions in ``__gone`` (null if none)."""
    marked = docs.withColumns({"__id": F.col("doc_id"), "__text_hash": F.xxhash64("text")})
    gone = removals(docs, min_sites).select(F.col("__id").alias("__gone_id"), F.col("__text_hash").alias("__gone_hash"), "__gone")
    joined = marked.join(gone, F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__text_hash") == F.col("__gone_hash")), "left")
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__gone")))
    return joined.withColumn("__kept", kept).drop("__gone_id", "__gone_hash", *ROW)


def line_report(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_sha256 (of what is left; null for a null text)."""
    done = dedup_lines(docs.select("doc_id", "text", "source"), min_sites)
    return done.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"), F.char_length("__kept").alias("n_chars"), F.sha2(F.col("__kept").cast("binary"), 256).alias("text_sha256"))


def drop_boilerplate(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The documents, all columns, with boilerplate lines taken out of the text; n_chars follows where there is such a column.
    Rows travel as one struct, so their other columns may have any name."""
    row = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("__row"))
    new = {"text": F.col("__kept"), "n_chars": F.char_length("__kept").cast("bigint")}
    return dedup_lines(row, min_sites).select(*(new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns))
