"""Document fingerprints: one-permutation MinHash, optimally densified, kept as packed low-order bits.

Each five-word shingle is hashed once; the high bits choose its bin and a bin keeps its least value. An empty bin takes the
value of the first filled bin in a sequence of bins that depends on its number alone, so two documents look in the same
places. Of each bin ``BITS`` low-order bits are kept. Bins of different sets agree by chance in one of 2^BITS cases; the
likeness is corrected for that.

Defined results: a null or empty text (or one of white space only) has no shingle and the fingerprint ''; its likeness is 1
to another such text and 0 to any other. A text of one to four words has one shingle. Equal texts have equal fingerprints.
Null ids come before all others; equal ids follow one another in the order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import U64, grams, mix, runs, words_of

BINS, BITS, WORDS = 1024, 4, 5
SHIFT = U64(64 - 10)  # 10 bits for 1024 bins
CHANCE = 1 / (1 << BITS)
BUCKET_ROWS, MOST_BUCKETS = 2000, 100_000
SLICE = 500


def _minima(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each bin (documents x BINS) and which bins are filled."""
    n = len(first) - 1
    out = np.full(n * BINS, ~U64(0), U64)
    owner = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(out, owner * BINS + (values >> SHIFT).astype(np.int64), values)
    out = out.reshape(n, BINS)
    filled = np.zeros((n, BINS), bool)
    filled.ravel()[owner * BINS + (values >> SHIFT).astype(np.int64)] = True
    return out, filled


def _densify(minima: np.ndarray, filled: np.ndarray) -> None:
    """Gives each empty bin the value of the first filled one in its sequence; documents without any stay as they are."""
    number = filled.sum(axis=1)
    for d in np.flatnonzero(number == 1):
        minima[d] = minima[d, filled[d].argmax()]
    doc, place = np.nonzero(~filled & (number > 1)[:, None])
    seed, step = mix(np.arange(BINS, dtype=U64) + U64(1)), np.full(BINS, 0x9E3779B97F4A7C15, U64)
    attempt = 0
    while len(doc):
        attempt += 1
        look = (mix(seed + step * U64(attempt)) >> SHIFT).astype(np.int64)[place]
        ok = filled[doc, look]
        minima[doc[ok], place[ok]] = minima[doc[ok], look[ok]]
        doc, place = doc[~ok], place[~ok]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of each bin (texts x BINS, one byte each) and which texts have shingles."""
    out, some = [], []
    for words in words_of(pa.array(texts, pa.large_string())):
        values, first = grams(words, WORDS)
        has = np.zeros(words.documents, bool)
        has[runs(first)] = True
        minima, filled = _minima(values, first)
        _densify(minima, filled)
        low = (mix(minima ^ mix(np.arange(BINS, dtype=U64))) & U64((1 << BITS) - 1)).astype(np.uint8)  # copied bins agree by chance independently
        low[~has] = 0
        out.append(low)
        some.append(has)
    if not out:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(some)


def packed(low: np.ndarray, has: np.ndarray) -> list[str]:
    """Fingerprints as lowercase hex, BITS bits a bin."""
    halves = low[:, 0::2] << np.uint8(4) | low[:, 1::2]
    return [row.tobytes().hex() if ok else "" for row, ok in zip(halves, has)]


def unpack(fingerprint: str) -> np.ndarray:
    data = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([data >> 4, data & 15], axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row."""
    agree = (a == b).mean(axis=1)
    estimate = np.clip((agree - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    return np.where(has_a & has_b, estimate, (has_a == has_b).astype(float))


def edited(text: str | None, following: str | None) -> str:
    """The text with its last quarter (rounded down) replaced by as much of the start of the following one."""
    text, following = text or "", following or ""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _dealt(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): ranges of ids, each followed by a guest, the first row of the next range. The ranges
    begin at ids of the table, at most ``MOST_BUCKETS`` of them; the last one's guest is the very first row."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = min(MOST_BUCKETS, max(1, size["n"] // BUCKET_ROWS))
    starts = []
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        starts = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * buckets)).alias("q")).first()["q"] or []
    least, nulls = size["least"], bool(size["nulls"])
    starts = np.array(sorted({s for s in starts if nulls or s > least}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            bucket = np.where(known, np.searchsorted(starts, ids, "right"), 0)
            opens = known & (bucket > 0) & (starts[np.maximum(bucket, 1) - 1] == ids) if len(starts) else np.zeros(len(ids), bool)
            wraps = ~known if nulls else known & (ids == least)
            rows = np.concatenate((np.arange(len(ids)), np.flatnonzero(opens), np.flatnonzero(wraps)))
            where = np.concatenate((bucket, bucket[opens] - 1, np.full(wraps.sum(), len(starts))))
            guest = np.arange(len(rows)) >= len(ids)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(guest), taken.column("doc_id"), taken.column("text")], ["bucket", "guest", "doc_id", "text"])

    return ids.mapInArrow(run, "bucket int, guest boolean, doc_id bigint, text string")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order; each one is done when the row after it is known."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []  # bucket, guest, id, text of the last row; its bits and whether it has shingles
    bits, some = np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            rows = held + list(zip(*(part.column(k).to_pylist() for k in ("bucket", "guest", "doc_id", "text"))))
            new, has = fingerprints([r[3] for r in rows[len(held) :]])
            bits, some = np.concatenate((bits, new)), np.concatenate((some, has))
            at = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
            if at:
                changed = [edited(rows[i][3], rows[i + 1][3]) for i in at]
                other, has_other = fingerprints(changed)
                own, after = bits[at], bits[np.array(at) + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(rows[i][3] or "") for i in at], pa.int64()),
                     pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                     pa.array(packed(own, some[at])), pa.array(packed(other, has_other)),
                     pa.array(likeness(own, other, some[at], has_other)), pa.array(likeness(own, after, some[at], some[np.array(at) + 1]))], names)
            held, bits, some = rows[-1:], bits[-1:], some[-1:]


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row; the next
    document is the one that follows by doc_id, after the last the first. Texts move once, to ranges of ids."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs).repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text").mapInArrow(_report, schema)
