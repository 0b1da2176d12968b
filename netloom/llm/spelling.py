"""Spelling variants: words one edit apart, found by sorted permuterm rotations.

A word of L code points is closed by a terminator and rotated. The rotation that begins behind the edited code point and ends
before it is a prefix shared by all words that differ there and nowhere else, and it is the whole rotation of the word without
that code point. So one key meets its replacements and its indels; a group holds at most one word for each letter and one more.

Defined results: a null text has no words; a null id counts as the empty text before the colon. Repeated rows count each time.
Equal numbers are decided by code-point order. An empty table gives no rows. Other columns are not read. Words of any length are
compared: keys of words of more than ``LONG`` code points are digests of what stands before and behind the edit, so that the rows
of a word stay in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
LONG = 64
ROWS = 20_000
_KEYS = "key string, id string, n long, letter string, lead boolean"


def occurrences(docs: DataFrame, least_length: int = 6, drop_every: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lowered, each run that its hash selects without one code point."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), "text").select("i", run.alias("r"))
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.when(F.col("r") == F.lower("r"), F.col("r")).otherwise(F.translate("r", upper, upper.lower()))
    hashed = runs.select(lowered.alias("w"), "i").select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2, F.length("w")))
    words = hashed.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _rotations(words: DataFrame) -> DataFrame:
    """A key for every letter (what is left of the rotation without it) and for every gap (the whole rotation)."""
    size = F.length("word")
    at = F.when(F.col("k") <= size, F.col("k")).otherwise(F.col("k") - size)  # letter 1..L; then gap 1..L+1, before that letter
    letter = F.when(F.col("k") <= size, F.substr("word", at, F.lit(1)))
    behind = F.substr("word", F.when(F.col("k") <= size, at + 1).otherwise(at), size)
    before = F.substr("word", F.lit(1), at - 1)
    lead = letter.isNotNull() & ((at == 1) | (F.substr("word", at - 1, F.lit(1)) != letter))
    return words.select("word", "n", F.explode(F.sequence(F.lit(1), 2 * size + 1)).alias("k")).select(
        F.concat(behind, F.lit("$"), before).alias("key"), F.col("word").alias("id"), "n", letter.alias("letter"), lead.alias("lead"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same keys for long words, as digests of both sides."""
    def sides(text: bytes) -> list[bytes]:
        h, out = hashlib.blake2b(digest_size=12), []
        out.append(h.digest())
        for k in range(len(text)):
            h.update(text[k : k + 1])
            out.append(h.digest())
        return out

    def keys(word: str, n: int):
        text = word.encode("latin-1")
        size, name = len(text), long_id(word) if len(text) > LONG else word
        before, behind = sides(text), sides(text[::-1])
        for k in range(size + 1):
            yield (before[k] + behind[size - k]).hex(), name, n, None, False
            if k < size and size > LONG:
                yield (before[k] + behind[size - k - 1]).hex(), name, n, word[k], k == 0 or word[k] != word[k - 1]

    held: list[tuple] = []
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for row in keys(word, n):
                held.append(row)
                if len(held) == ROWS:
                    yield _batch(held)
                    held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "id", "n", "letter", "lead"])


def long_id(word: str) -> str:
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def _scan(rows: DataFrame) -> DataFrame:
    """(id, near, n, best) for each row of a key that has a near word there: how many, and the largest n and its word.

    Inside a key, words of equal n stand in code-point order of their letter. An indel counts at the first of equal letters."""
    key = Window.partitionBy("key")
    by_n = key.orderBy(F.col("letter").isNull(), F.col("n").desc(), "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    it = F.struct("n", "id", "letter")
    lead = F.when(F.col("lead"), F.struct("n", (-F.ascii("letter")).alias("l"), "id"))
    seen = rows.select(
        "id", "letter", "lead", F.count("letter").over(by_n).alias("letters"), F.count(F.when(F.col("lead"), 1)).over(by_n).alias("leads"),
        F.first(it).over(by_n).alias("first"), F.nth_value(it, 2).over(by_n).alias("second"), F.max(lead).over(by_n).alias("top_lead"),
        F.max(F.when(F.col("letter").isNull(), F.struct("n", "id"))).over(by_n).alias("whole"))
    is_letter = F.col("letter").isNotNull()
    other = F.when(F.col("letters") > 1, F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first")))
    shorter = F.when(F.col("lead"), F.col("whole"))
    near = F.when(is_letter, F.col("letters") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("leads"))
    best = F.when(is_letter, F.array_min(F.array_compact(F.array(_ranked(other), _ranked(shorter))))).otherwise(_ranked(F.col("top_lead")))
    return seen.select("id", near.cast("long").alias("near"), best.alias("best")).where(F.col("near") > 0)


def _ranked(word: Column) -> Column:
    return F.when(word.isNotNull(), F.struct((-word["n"]).alias("m"), word["id"].alias("id")))


def _with_texts(found: DataFrame, longs: DataFrame) -> DataFrame:
    """Rows whose best word is long get its text: only those with the largest n of their word."""
    hashed = found.where(F.col("best.id").startswith("#"))
    sums = hashed.groupBy("id").agg(F.sum("near").alias("near"), F.min("best.m").alias("m"))
    top = hashed.select("id", F.col("best.m").alias("m"), F.col("best.id").alias("b")).join(sums.select("id", "m"), ["id", "m"]).distinct()
    text = top.join(longs.select(F.col("id").alias("b"), "word"), "b").groupBy("id").agg(F.min("word").alias("word"))
    named = sums.join(text, "id").select("id", "near", F.struct("m", F.col("word").alias("id")).alias("best"))
    return found.where(~F.col("best.id").startswith("#")).unionByName(named)


def near_words(words: DataFrame, longest: int | None = None) -> DataFrame:
    """(word, n, n_near, best, best_n) for the rows of ``words`` (word, n; words are distinct): how many words are one inserted,
    deleted or replaced code point away, and the one of largest n, ties to the smallest in code-point order."""
    if longest is None:
        longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    found = _scan(_rotations(words.where(F.length("word") <= LONG)))
    names = words.select(F.col("word").alias("id"), "word", "n")
    if longest > LONG:  # the shorter word of a pair may have LONG code points itself
        longs = words.where(F.length("word") > LONG).select(F.concat(F.lit("#"), F.sha2("word", 256)).alias("id"), "word", "n")
        far = words.where(F.length("word") >= LONG).select("word", "n").repartition("word").mapInArrow(_digests, _KEYS)
        found = _with_texts(found.unionByName(_scan(far)), longs)
        names = names.where(F.length("word") <= LONG).unionByName(longs)
    short = names.where(~F.col("id").startswith("#")).select("id", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<m: bigint, id: string>").alias("best"))
    out = short.unionByName(found.select("id", F.lit(None).cast("long").alias("n"), "near", "best")).groupBy("id").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = [F.col("best.id").alias("best"), (-F.col("best.m")).alias("best_n")]
    plain = out.where(~F.col("id").startswith("#")).select(F.col("id").alias("word"), "n", "n_near", *best)
    if longest <= LONG:
        return plain
    rest = longs.join(out.select("id", "n_near", *best), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best", "best_n")
    return plain.unionByName(rest)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the form of a word is its near word of largest n, where that is ``ratio`` times its own;
    the root is the last of the forms. ``words`` is (word, n), distinct, and read more than once.

    n grows by ``ratio`` from form to form, so the length of a chain has a bound that the largest and smallest n give; each round
    doubles what a word has followed."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    size = words.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.max(F.length("word")).alias("longest")).first()
    near = near_words(words, size["longest"] or 0)
    is_form = F.col("best_n") >= ratio * F.col("n")
    linked = cut_lineage(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    up = linked.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    steps, n = 1, max(1, size["least"] or 1) * ratio * ratio
    while n <= (size["most"] or 0):
        steps, n = steps + 1, n * ratio
    followed = 1
    while followed < steps:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut_lineage(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        followed *= 2
    return linked.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, drop_every: int = 199) -> DataFrame:
    """Variants among the words of whole texts that have ``least_length`` code points and ``least_count`` occurrences."""
    words = occurrences(docs, least_length, drop_every).where(F.col("n") >= least_count)
    return variants(cut_lineage(words), ratio)
