"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks, decided by
exact weighted-shingle similarity.

A window has as many words as the item it is compared with (the whole document where that is shorter). Windows without a
single five-word shingle of the benchmark have similarity 0 and get no fingerprint. A 64-bit fingerprint is cut into
``BLOCKS`` parts; two within ``radius`` bits differ by at most radius // BLOCKS bits in one part, so looking up every part
with that many bits flipped finds all of them. Similarity is weighted Jaccard of the shingle multisets; a shingle weighs
log(1 + items / items that have it), one outside the benchmark as much as one of a single item. Fingerprints add up the
square roots of the weights: their cosine then follows the weights themselves, as the weighted Jaccard does.

The benchmark is taken in blocks of bounded size, each sent to the tasks and run against all documents; nothing of the
documents is sent or shuffled. Defined results: null or empty texts match nothing; an item of fewer than five words is one shingle
of all its words and is found where they stand in a row; null and empty items are not searched for; equal items are each reported; of several windows the most
similar one counts, then the earliest. Rows that repeat an id are each searched, but rows of equal id and equal shingles
are one item: it is searched, counted and reported once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import U64, Words, grams, mix, multipliers, words_of

BITS, BLOCKS, FILTER = 64, 6, 20
SCALE = 256  # weights are whole numbers in fingerprints, so sums do not depend on their order


@dataclass(frozen=True)
class Search:
    threshold: float = 0.8
    words: int = 5
    radius: int = 17
    block_items: int = 20_000
    block_bytes: int = 16 << 20


@dataclass
class Index:
    """One block of the benchmark."""

    items: list
    lengths: np.ndarray
    shingles: list[dict[int, int]]
    vocabulary: np.ndarray
    weights: np.ndarray
    outside: float
    owners: list[np.ndarray]
    prints: np.ndarray
    how: Search
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1 << FILTER, bool))
    parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # by words: shingle of all words, places in items


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _whole(weights: np.ndarray | float) -> np.ndarray:
    return np.maximum(1, np.rint(np.sqrt(np.asarray(weights)) * SCALE)).astype(np.int32)


def _flips(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in at) for k in range(most + 1) for at in combinations(range(width), k)], np.int64)


def build_index(rows: list[tuple[object, int, list[int], list[float]]], outside: float, how: Search) -> Index:
    """rows: item id, number of words, its shingles in order, their weights."""
    known: dict[int, float] = {}
    owners: dict[int, set[int]] = {}
    shingles = []
    few = [r for r in rows if r[1] < how.words]
    rows = [r for r in rows if r[1] >= how.words]
    for k, (_, _, own, weights) in enumerate(rows):
        own = [int(s) & (2**64 - 1) for s in own]
        known.update(zip(own, weights))
        for s in own:
            owners.setdefault(s, set()).add(k)
        shingles.append(dict(Counter(own)))
    vocabulary = np.array(sorted(known), U64)
    weights = np.array([known[int(s)] for s in vocabulary])
    prints = []
    for own in shingles:
        s = np.array(list(own), U64)
        w = _whole([known[int(x)] for x in s]) * np.array(list(own.values()), np.int32)
        prints.append(_pack((_signs(s) * w[:, None]).sum(axis=0, keepdims=True))[0])
    index = Index([r[0] for r in rows + few], np.array([r[1] for r in rows], np.int64), shingles, vocabulary, weights, outside,
                  [np.array(sorted(owners[int(s)]), np.int64) for s in vocabulary], np.array(prints, U64), how)
    for k, (_, n, own, _) in enumerate(few):
        index.short.setdefault(n, {}).setdefault(int(own[0]) & (2**64 - 1), []).append(len(rows) + k)
    index.totals = np.array([sum(known[s] * n for s, n in own.items()) for own in shingles])
    index.filter[(vocabulary >> U64(64 - FILTER)).astype(np.int64)] = True
    edges = np.linspace(0, BITS, BLOCKS + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:]):
        width = int(high - low)
        value = ((index.prints >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        offsets = np.searchsorted(value[order], np.arange((1 << width) + 1))
        index.parts.append((int(low), width, order, offsets, _flips(width, how.radius // BLOCKS)))
    return index


def within_radius(index: Index, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (fingerprint, item, distance) with a distance within the radius."""
    pairs = []
    for low, width, order, offsets, flips in index.parts:
        value = ((prints >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
        probe = value[:, None] ^ flips[None, :]
        a = offsets[probe]
        n = offsets[probe + 1] - a
        row, col = np.nonzero(n)
        if not len(row):
            continue
        n, a = n[row, col], a[row, col]
        which = np.repeat(row, n)
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pairs.append(which.astype(np.int64) * len(index.items) + order[at])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(pairs))
    which, item = both // len(index.items), both % len(index.items)
    distance = np.bitwise_count(prints[which] ^ index.prints[item]).astype(np.int64)
    ok = distance <= index.how.radius
    return which[ok], item[ok], distance[ok]


def similarity(index: Index, window: np.ndarray, weights: np.ndarray, item: int) -> float:
    """Weighted Jaccard of the window's shingles (with their weights) and the item's."""
    own = index.shingles[item]
    total, common, seen = float(weights.sum()), 0.0, Counter()
    for s, w in zip(window.tolist(), weights.tolist()):
        if seen[s] < own.get(s, 0):
            common += w
        seen[s] += 1
    return common / (total + index.totals[item] - common)


def _clusters(hits: np.ndarray, gap: int) -> list[np.ndarray]:
    return np.split(hits, np.flatnonzero(np.diff(hits) > gap) + 1)


def search_document(index: Index, g: np.ndarray, n_words: int, hits: np.ndarray, known: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
    """Best window of each item: similarity, start, words, distance. g: the document's shingles; hits: the places of those
    that the benchmark has, known: their places in the vocabulary."""
    how, best = index.how, {}
    candidates = np.unique(np.concatenate([index.owners[k] for k in np.unique(known)]))
    for length in np.unique(np.minimum(index.lengths[candidates], n_words)).tolist():
        span = length - how.words + 1
        for part in _clusters(hits, span):
            low, high = max(0, int(part[0]) - span + 1), min(n_words - length, int(part[-1]))
            if high < low:
                continue
            region = g[low : high + span]
            weight = np.full(len(region), index.outside)
            inside = (hits >= low) & (hits < high + span)
            weight[hits[inside] - low] = index.weights[known[inside]]
            touched = np.zeros(len(region) + 1, np.int64)
            touched[1:] = np.cumsum(np.bincount(hits[inside] - low, minlength=len(region)))
            for at in range(0, high - low + 1, 8192):
                stop = min(at + 8192, high - low + 1)
                sums = np.zeros((stop - at + span, BITS), np.int64)
                np.cumsum(_signs(region[at : stop + span - 1]) * _whole(weight[at : stop + span - 1])[:, None], axis=0, out=sums[1:])
                some = np.flatnonzero(touched[at + span : stop + span] > touched[at:stop])
                prints = _pack(sums[some + span] - sums[some])
                for w, item, distance in zip(*within_radius(index, prints)):
                    if min(int(index.lengths[item]), n_words) != length:
                        continue
                    start = at + int(some[w])
                    s = similarity(index, region[start : start + span], weight[start : start + span], int(item))
                    found = (s, -(low + start), length, int(distance))
                    if s >= how.threshold - 1e-9 and found > best.get(int(item), (-1.0,)):
                        best[int(item)] = found
    return {k: (s, -start, length, distance) for k, (s, start, length, distance) in best.items()}


def search(index: Index, words: Words) -> Iterator[tuple[int, dict[int, tuple[float, int, int, int]]]]:
    """Row and matches of each document of the piece that has any."""
    found = _whole_items(index, words)
    if len(index.vocabulary):
        for d, more in _windows(index, words):
            found.setdefault(d, {}).update(more)
    for d in sorted(found):
        yield words.row + d, found[d]


def _whole_items(index: Index, words: Words) -> dict[int, dict[int, tuple[float, int, int, int]]]:
    """Items of fewer words than a shingle, by document: the first place where all their words stand in a row."""
    out: dict[int, dict[int, tuple[float, int, int, int]]] = {}
    for length, known in index.short.items():
        g, first = word_runs(words, length)
        hits = np.flatnonzero(np.isin(g, np.array(list(known), U64)))
        owner = np.searchsorted(first, hits, "right") - 1
        for at, d in zip(hits.tolist(), owner.tolist()):
            for item in known[int(g[at])]:
                out.setdefault(d, {}).setdefault(item, (1.0, at - int(first[d]), length, 0))
    return out


def word_runs(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, as a text of just these words has for its one shingle, and each document's first."""
    number = np.maximum(np.diff(words.first) - n + 1, 0)
    weights = multipliers(n, 5)
    total = max(len(words.hashes) - n + 1, 0)
    rolled = np.full(total, U64(n))
    for j in range(n):
        rolled += words.hashes[j : j + total] * weights[j]
    first = np.concatenate(([0], np.cumsum(number)))
    at = np.arange(first[-1]) - np.repeat(first[:-1], number) + np.repeat(words.first[:-1], number)
    return mix(rolled[at]), first


def _windows(index: Index, words: Words) -> Iterator[tuple[int, dict[int, tuple[float, int, int, int]]]]:
    g, first = grams(words, index.how.words, short=False)
    maybe = np.flatnonzero(index.filter[(g >> U64(64 - FILTER)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.vocabulary, g[maybe]), len(index.vocabulary) - 1)
    real = index.vocabulary[place] == g[maybe]
    hits, place = maybe[real], place[real]
    owner = np.searchsorted(first, hits, "right") - 1
    for d in np.unique(owner).tolist():
        own = owner == d
        found = search_document(index, g[first[d] : first[d + 1]], int(words.first[d + 1] - words.first[d]), hits[own] - first[d], place[own])
        if found:
            yield d, found


def _items(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, number of words and shingles in order of the items that have words; each (item_id, shingles) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = [], []
            for words in words_of(batch.column("text")):
                g, first = grams(words, n)
                sizes += np.diff(words.first).tolist()
                own += [g[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["item_id", "n_words", "shingles"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n_words bigint, shingles array<bigint>").where(F.size("shingles") > 0)
    return found.dropDuplicates(["item_id", "shingles"])


def indexes(benchmark: DataFrame, how: Search = Search()) -> list[Index]:
    """The benchmark in blocks; each holds at most about ``block_items`` items and ``block_bytes`` of shingles."""
    items = _items(benchmark, how.words)
    size = items.agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= how.words).alias("long"), F.sum(8 * F.size("shingles")).alias("bytes")).first()
    if not size["n"]:
        return []
    blocks = max(math.ceil(size["n"] / how.block_items), math.ceil(size["bytes"] / how.block_bytes))
    each = items.withColumn("row", F.xxhash64("item_id", "shingles"))
    exploded = each.select("row", "item_id", "n_words", F.posexplode("shingles").alias("pos", "s"))
    df = exploded.groupBy("s").agg(F.count_distinct("row").alias("df"))
    weighed = (exploded.join(df, "s").withColumn("w", F.log(1 + F.lit(size["long"]) / F.col("df")))
               .groupBy("row", "item_id", "n_words").agg(F.sort_array(F.collect_list(F.struct("pos", "s", "w"))).alias("own")))
    out = []
    for k in range(blocks):
        rows = weighed.where(F.pmod("row", F.lit(blocks)) == k).orderBy("item_id", "row").collect()
        if rows:
            out.append(build_index([(r["item_id"], r["n_words"], [x["s"] for x in r["own"]], [x["w"] for x in r["own"]]) for r in rows], math.log(1 + size["long"]), how))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """doc_id, item_id, start (word), n_words, hamming, similarity: the best window of each item found in a document."""
    ids, items = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids}, item_id {items}, start bigint, n_words bigint, hamming int, similarity double"
    rows = docs.select("doc_id", "text")
    out = None
    for index in indexes(benchmark, how):
        part = rows.mapInArrow(_matcher(_sent(docs, index), to_arrow_type(benchmark.schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _sent(docs: DataFrame, index: Index):
    """Broadcast of a block, its class by value, so that executors need not have the package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))


def _matcher(held, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = cloudpickle.loads(held.value)
        for batch in batches:
            rows, out = [], []
            for words in words_of(batch.column("text")):
                for row, found in search(index, words):
                    for item in sorted(found):
                        s, start, length, distance = found[item]
                        rows.append(row)
                        out.append((index.items[item], start, length, distance, s))
            columns = list(zip(*out)) or [()] * 5
            kinds = [item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "item_id", "start", "n_words", "hamming", "similarity"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """The documents, all columns, in which no benchmark item was found."""
    for index in indexes(benchmark, how):
        docs = docs.mapInArrow(_cleaner(_sent(docs, index)), docs.schema)
    return docs


def _cleaner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = cloudpickle.loads(held.value)
        for batch in batches:
            out = np.ones(batch.num_rows, bool)
            for words in words_of(batch.column("text")):
                for row, _ in search(index, words):
                    out[row] = False
            yield batch.filter(pa.array(out))

    return run
