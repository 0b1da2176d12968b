"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training takes FTRL-proximal steps with an elastic-net penalty, then one temperature is fitted on rows kept back.
Document frequencies are counted over every learnable row; the weights are fitted on a bounded sample of them
(``LanguageId.sample`` rows in all, shared evenly between the languages and chosen by a hash of the row id).

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing can be
learned (no labelled row). Repeated rows get equal answers. Ties between languages go to the first in sorted order.
A null id is never learned from and counts as not held out. Long texts are counted whole, in segments. Other columns
of the input are ignored by ``predict``, and kept as they are by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
BUCKETS = 1 << 13
SHIFT = np.uint32(19)  # 32 bits less the 13 of BUCKETS
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
ORDERS = (1, 2, 3)
SEGMENT = 1 << 19
GROUP = 64
SLICE = 512
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageId:
    """Parameters of training. ``sample`` bounds the rows that reach the fit, whatever the input's size."""

    sample: int = 3000
    epochs: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.0005
    calibration: int = 5  # every fifth sampled row fits the temperature instead of the weights


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's text leaves 1 modulo 3; these are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for anything else."""
    if not _letters:
        table = np.zeros(1 << 16, np.uint32)
        for code in range(1 << 16):
            if (ch := chr(code)).isalpha():
                low = ch.lower()
                table[code] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def _symbols(text: str) -> np.ndarray:
    """Each letter in lower case, 0 for any other character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _letter_table()[np.minimum(codes, 0xFFFF)]
    for code in set(codes[codes > 0xFFFF].tolist()):
        if chr(code).isalpha():
            out[codes == code] = code
    return out


def count_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (texts x BUCKETS) and whether each text has a letter. A run of other characters counts as one."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    letter = np.zeros(len(texts), bool)
    parts: list[str] = []
    owners: list[int] = []

    def flush() -> None:
        codes = _symbols("".join(parts))
        owner = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep], owner[keep] * BUCKETS
        some = codes != 0
        letter[owner[some] // BUCKETS] = True
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            inside = owner[:m] == owner[n - 1 :]
            real = some[:m].copy()
            for j in range(n):
                h += codes[j : j + m] * FACTORS[j]
                real |= some[j : j + m]
            h ^= h >> np.uint32(15)
            h *= FACTORS[-1]
            counts.ravel()[:] += np.bincount((owner[:m] + (h >> SHIFT))[inside & real], minlength=counts.size)
        parts.clear()
        owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for low in range(0, len(text or ""), SEGMENT):
            parts.append(text[low : low + SEGMENT] + " ")
            owners.append(i)
            held += len(parts[-1])
            if held >= SEGMENT:
                flush()
                held = 0
    if parts:
        flush()
    return counts, letter


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of each bucket, and in bucket -1 the number of documents, summed over one task."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for low in range(0, batch.num_rows, GROUP):
            counts, _ = count_ngrams(batch.column("text").slice(low, GROUP).to_pylist())
            total += (counts > 0).sum(axis=0)
        n += batch.num_rows
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], n), pa.int64())], ["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts of the sampled rows."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        index, value = [], []
        for low in range(0, len(texts), GROUP):
            counts, _ = count_ngrams(texts[low : low + GROUP])
            for row in counts:
                at = np.flatnonzero(row)
                index.append(at.astype(np.int16).tobytes())
                value.append(row[at].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("lang"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["place", "lang", "buckets", "counts"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, total: int, how: LanguageId) -> Model:
    """FTRL-proximal over the sampled rows (language, buckets, counts), in the given order."""
    languages = sorted({r[0] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    data = []
    for lang, at, count in rows:
        x = np.log1p(count) * idf[at]
        data.append((at, x / max(np.linalg.norm(x), 1e-12), place[lang]))
    kept = [d for i, d in enumerate(data) if (i + 1) % how.calibration == 0]
    used = [d for i, d in enumerate(data) if (i + 1) % how.calibration] or data
    shape = (len(idf) + 1, len(languages))  # the last row is the bias
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for _ in range(how.epochs):
        for at, x, y in used:
            i = np.append(at, shape[0] - 1)
            v = np.append(x, 1.0)
            zi, ni = z[i], n[i]
            wi = -np.sign(zi) * np.maximum(np.abs(zi) - how.l1, 0) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2)
            p = _softmax(v @ wi)
            p[y] -= 1.0
            g = v[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha
            z[i] = zi + g - step * wi
            n[i] = ni + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - how.l1, 0) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in kept]).reshape(-1, len(languages))
    heat = _temperature(logits, np.array([d[2] for d in kept], int))
    return Model(languages, idf.astype(np.float32), w[:-1].astype(np.float32), w[-1], heat)


def train(docs: DataFrame, how: LanguageId = LanguageId()) -> Model | None:
    """Learns from (doc_id, text, lang) rows that are not held out; None if there is none."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    found = rows.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency, total = np.zeros(BUCKETS), 0
    for r in found:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            frequency[r["bucket"]] = r["n"]
    share = how.sample / len(sizes)
    chance = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, share / n)))])
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("language")), 11)  # 53 bits, exact as a double
    chosen = (rows.select(place.alias("place"), "lang", "text").where(F.col("place") < F.element_at(chance, F.col("lang")) * F.lit(float(2**53)))
              .mapInArrow(_sparse, "place bigint, lang string, buckets binary, counts binary").orderBy("place", "lang", "buckets", "counts").limit(2 * how.sample).collect())
    data = [(r["lang"], np.frombuffer(r["buckets"], np.int16).astype(np.int64), np.frombuffer(r["counts"], np.float32).astype(float)) for r in chosen]
    return fit(data, frequency, total, how) if data else None


def score_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    names, scores = [], np.zeros(len(texts))
    for low in range(0, len(texts), GROUP):
        part = texts[low : low + GROUP]
        counts, letter = count_ngrams(part)
        if model is None:
            names += [UNKNOWN] * len(part)
            continue
        x = np.log1p(counts) * model.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        p = _softmax((x @ model.weights + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
        scores[low : low + GROUP] = np.where(letter, p[np.arange(len(part)), best], 0.0)
    return names, scores


def _scored(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Of a whole column, taken in slices so that few texts are held as Python strings."""
    parts = [score_texts(model, column.slice(low, SLICE).to_pylist()) for low in range(0, len(column), SLICE)]
    return [n for names, _ in parts for n in names], np.concatenate([s for _, s in parts]) if parts else np.zeros(0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _scored(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """Documents, all columns, whose language is known with a score of at least ``least``; the others are rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _scored(model, batch.column("text"))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
