"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes the set of hashes of its five-word shingles. Documents with equal sets are one class from then on.
2. Band and row counts follow from the threshold and the target recall. A band hash is a bucket; buckets with the same
   members are one (the first band's).
3. Sets are brought to the buckets once each. A bucket of many members is cut into blocks, and block meets block in
   different tasks. A pair is decided in the first band it shares, so it counts once. No pair is written: each block
   gives, for a class, its number of links and one link towards the smallest member that it is connected with there.
4. Components of those links are the classes of near copies.

Defined results: null and empty texts have an empty set and form one class of copies; a text of one to four words has
one shingle. Copies are not expanded: ``n_links`` counts the other documents at or above the threshold, copies included,
``n_linked_texts`` the different sets among them. The smallest doc_id stands for a group; null ids come last. Rows that
repeat an id count as rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import components
from .grouped import grouped
from .words import U64, grams, mix, multipliers, runs, unique_per_document, words_of

BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Join:
    threshold: float = 0.8
    words: int = 5
    recall: float = 0.9999  # chance that a pair right at the threshold shares a band
    most_bands: int = 24

    def shape(self) -> tuple[int, int]:
        """(bands, rows a band): the most rows whose bands for the recall stay within ``most_bands``; where even one row needs
        more bands than that, as at low thresholds, it gets them."""
        if self.threshold >= 1:
            return 1, 19
        needed = {rows: max(1, math.ceil(math.log(1 - self.recall) / math.log1p(-(self.threshold**rows)))) for rows in range(1, 20)}
        rows = max((r for r, bands in needed.items() if bands <= self.most_bands), default=1)
        return needed[rows], rows


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, sorted distinct shingles and offsets, piece by piece."""
    for words in words_of(column):
        values, first = grams(words, n)
        yield words.row, *unique_per_document(values, first)


def _keys(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits that name each set."""
    at = runs(first)
    out = np.zeros((len(first) - 1, 2), U64)
    for k in range(2):
        if len(at):
            out[at, k] = mix(np.add.reduceat(mix(values + U64(k + 1)), first[:-1][at]))
    return [row.tobytes() for row in out]


def _bands(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each set; those of empty sets are 0."""
    at = runs(first)
    out = np.zeros((len(first) - 1, bands), U64)
    if not len(at):
        return out
    factors, weights = multipliers(bands * rows, 17), multipliers(rows, 23)
    begin = first[:-1][at]
    for b in range(bands):
        total = np.full(len(at), b + 1, U64)
        for r in range(rows):
            total += np.minimum.reduceat(values * factors[b * rows + r], begin) * weights[r]
        out[at, b] = mix(total)
    return out


def signatures(docs: DataFrame, how: Join) -> DataFrame:
    """doc_id, text hash, set key, set size and band hashes of every row."""
    bands, rows = how.shape()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for _, values, first in _sets(batch.column("text"), how.words):
                keys += _keys(values, first)
                sizes.append(np.diff(first))
                hashes.append(_bands(values, first, bands, rows))
            flat = np.concatenate(hashes).view(np.int64).ravel() if hashes else np.zeros(0, np.int64)
            offsets = np.arange(0, len(flat) + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "text_hash", "key", "size", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, key binary, size bigint, bands array<bigint>")


def _with_sets(docs: DataFrame, wanted: DataFrame, how: Join) -> DataFrame:
    """Key and packed shingles of the one row that stands for each wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, values, first in _sets(batch.column("text"), how.words):
                packed += [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], ["key", "shingles"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wanted = wanted.select("key", F.col("place.last").alias("w_last"), F.col("place.doc_id").alias("w_id"), F.col("place.text_hash").alias("w_hash"))
    found = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["w_id"]) & (rows["text_hash"] == wanted["w_hash"]))
    return found.select("key", "text").mapInArrow(run, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of parts of the members x shingles incidence."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _links(sets: list[np.ndarray], bands: np.ndarray, band: int, block: np.ndarray, low: int, high: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the threshold that the group of blocks ``low`` and ``high`` is to count: across the two or,
    where they are one, within it, and not sharing an earlier band. A block may have no member."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(m, 1)
    if low != high:  # two blocks: pairs within one are counted where it meets itself
        across = block[i] != block[j]
        i, j = i[across], j[across]
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    for k in range(band):
        later = bands[i, k] != bands[j, k]
        i, j = i[later], j[later]
    same = bands[i, band] == bands[j, band]
    i, j = i[same], j[same]
    if not len(i):
        return i, j
    if len(i) <= 6:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    else:
        common = np.rint(_shared(sets)[i, j]).astype(np.int64)
    ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[ok], j[ok]


def _roots(m: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each member the one of smallest rank in its component, by repeated minimum over links."""
    label = order.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            back = np.empty(m, np.int64)
            back[order] = np.arange(m)
            return back[label]
        label = new


def _decide(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    names = ["key", "texts", "documents", "root"]
    for table in grouped(batches, ["hash", "band", "low", "high"]):
        keys = table.column("key").to_pylist()
        m = len(keys)
        sets = [np.frombuffer(s, U64) for s in table.column("shingles").to_pylist()]
        listed = table.column("bands").combine_chunks()
        bands = listed.flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
        band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        i, j = _links(sets, bands, band, table.column("block").to_numpy(), low, high, threshold)
        if not len(i):
            continue
        n = table.column("n").to_numpy()
        texts = np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
        documents = np.bincount(i, n[j], m) + np.bincount(j, n[i], m)
        rank = np.empty(m, np.int64)
        rank[sorted(range(m), key=keys.__getitem__)] = np.arange(m)
        root = _roots(m, i, j, rank)
        linked = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[x] for x in linked], pa.binary()), pa.array(texts[linked], pa.int64()), pa.array(documents[linked].astype(np.int64)),
             pa.array([keys[root[x]] for x in linked], pa.binary())], names)


def near_classes(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """Per row: doc_id, text_hash, leader (the row that stands for its class of near copies), class_id, copy_of (smallest
    id with the same shingle set), n_copies, n_links, n_linked_texts."""
    rows = cut_lineage(signatures(docs, how))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = rows.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    members = classes.where(F.col("size") > 0).select("key", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(
        F.count("*").alias("m"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y")).where(F.col("m") > 1)
    buckets = buckets.groupBy("m", "weight", "x", "y").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "m", "weight")
    placed = cut_lineage(members.join(buckets, ["band", "hash"]).select("key", "band", "hash", "m", "weight"))
    sets = _with_sets(docs, classes.join(placed.select("key").distinct(), "key", "left_semi"), how).join(classes.select("key", "bands", "n"), "key")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = (placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "band", "hash", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    group = ["hash", "band", "low", "high"]
    decided = (dealt.join(sets, "key").repartition(*group).sortWithinPartitions(*group)
               .select(*group, "block", "key", "n", "bands", "shingles")
               .mapInArrow(lambda it: _decide(it, how.threshold), "key binary, texts bigint, documents bigint, root binary"))
    links = cut_lineage(decided)
    label = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    known = (classes.select("key", "place", "n").join(counts, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("label", F.coalesce("label", "key")))
    leaders = known.groupBy("label").agg(F.min("place").alias("leader"))
    known = known.join(leaders, "label").select(
        "key", F.struct("leader.doc_id", "leader.text_hash").alias("leader"), F.col("leader.doc_id").alias("class_id"), F.col("place.doc_id").alias("copy_of"),
        F.col("n").alias("n_copies"), (F.col("n") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    return rows.select("doc_id", "text_hash", "key").join(known, "key").drop("key")


def link_report(docs: DataFrame, how: Join = Join()) -> DataFrame:
    return near_classes(docs.select("doc_id", "text"), how).select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "n_linked_texts")


def drop_near_copies(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The documents, all columns, less those for which another one of their class stands. Of rows with equal id (or none)
    and equal text one stays, where other columns differ the one whose hash of them is smallest."""
    found = near_classes(docs.select("doc_id", "text"), how)
    name = [F.xxhash64(F.col("doc_id").isNull(), "doc_id"), F.col("text_hash")]
    gone = found.where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("leader"))).select(*(x.alias(f"__gone{k}") for k, x in enumerate(name)))
    # The two hashes deal the rows out for both the aggregate and the join, so texts are shuffled once.
    rows = (docs.select(name[0].alias("__key0"), F.xxhash64("text").alias("__key1"), F.struct(*(docs[c] for c in docs.columns)).alias("__row"))
            .groupBy("__key0", "__key1").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")))
    return rows.join(gone, (F.col("__key0") == F.col("__gone0")) & (F.col("__key1") == F.col("__gone1")), "left_anti").select("__row.*")
