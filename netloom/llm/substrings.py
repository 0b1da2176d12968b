"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A passage is removed where a window of ``WINDOW`` words that covers it has also started earlier (smaller doc_id, or earlier
in the same document). Suffixes are taken at anchors: the anchor of a window is its ``PREFIX``-word gram of least hash (the
first of equals), so equal windows have equal anchors at equal offsets, and one suffix stands for all windows of its anchor.

1. A task collapses suffixes whose windows are all equal: later ones are repeats at once. The first ones are dealt out by
   the hash of their prefix, and collapsed again; prefixes with one suffix are leaves right below the root and end there.
2. The words around the remaining suffixes are brought to their prefix group. Groups of more than ``GROUP`` suffixes get a
   longer prefix, the whole window. Groups are packed into batches that fit in memory.
3. In a batch, suffixes sorted by the words that follow, with the lengths of common prefixes, are the subtrees; sorted by
   the words before, they are the trees of left extensions. Suffixes under one node of each, together ``WINDOW`` words
   deep, share a window; all but the earliest repeat it.
4. Repeated windows go back to their documents, by id, and mark the words that they cover.

Texts are moved once, by id; the rest moves only hashes and, for repeats, about thirty words a suffix. Words are 64-bit
hashes, windows are told apart by all twenty of them.

Defined results: null and empty texts have no words and keep nothing, which hashes as the empty string. Windows are judged on
the input. Null ids come before all others; rows that repeat an id follow one another in the order of their texts' hashes,
each a document of its own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .words import U64, Words, grams, mix, text_buffer, words_of

WINDOW, PREFIX = 20, 6
SPAN = WINDOW - PREFIX  # the largest offset of an anchor in its window
GROUP = 20_000
HELD = 1 << 20
BATCH = 50_000
_BASE = 0xD1342543DE82EF95
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 18)
        _tables[:] = [np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size, b, U64)))) for b in (U64(_BASE), U64(pow(_BASE, -1, 1 << 64)))]
    return _tables[0], _tables[1]


def anchors(words: Words) -> dict[str, np.ndarray]:
    """Anchors of all windows of a piece: document, position, prefix hash, hash of all words of its windows, and the least
    and largest offset of the anchor in them."""
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "pos", "prefix", "around", "low", "high")}
    count = np.diff(words.first)
    windows = np.maximum(count - WINDOW + 1, 0)
    if not windows.any():
        return empty
    h = words.hashes
    doc = np.repeat(np.arange(len(count)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + words.first[:-1][doc]
    g, first = grams(words, PREFIX, seed=11, short=False)
    shift = words.first[:-1] - first[:-1]  # place of a document's grams less place of its words
    at = start - shift[doc]
    best = np.lib.stride_tricks.sliding_window_view(g, SPAN + 1)
    anchor = start + np.concatenate([best[at[k : k + 65536]].argmin(axis=1) for k in range(0, len(at), 65536)])
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(anchor)) - 1
    a, d = anchor[begin], doc[begin]
    high, low = a - start[begin], a - start[end]
    up, down = _powers(len(h))
    sums = np.concatenate(([U64(0)], np.cumsum(h * up[: len(h)])))
    left, right = a - high, a - low + WINDOW
    around = mix((sums[right] - sums[left]) * down[left] + (high * 64 + low).astype(U64))
    return {"doc": d, "pos": a - words.first[:-1][d], "prefix": g[a - shift[d]].view(np.int64), "around": around.view(np.int64), "low": low, "high": high}


def _mask(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits low to high."""
    return (np.left_shift(2, high) - np.left_shift(1, low)).astype(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes at anchors, their position and range of offsets in one number; kind 1: another one of this task has the same windows earlier."""
    names = ["kind", "prefix", "around", "key", "place"]
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        c = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        order = np.lexsort((c["pos"], c["key"], c["around"], c["prefix"]))
        c = {k: v[order] for k, v in c.items()}
        same = np.zeros(len(order), np.int32)
        same[1:] = (c["prefix"][1:] == c["prefix"][:-1]) & (c["around"][1:] == c["around"][:-1])
        place = c["pos"] << 8 | c["high"] << 4 | c["low"]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (same, c["prefix"], c["around"], c["key"], place)], names)

    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for words in words_of(batch.column("text")):
            found = anchors(words)
            found["key"] = keys[words.row + found.pop("doc")] if len(found["pos"]) else found.pop("doc")
            held.append(found)
            size += len(found["pos"])
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _leaves(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The words around each listed suffix of a document; in an oversized group, each window for itself."""
    for batch in batches:
        listed = batch.column("suffixes")
        fields = {n: listed.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("place", "prefix", "n")}
        counts = np.diff(listed.offsets.to_numpy())
        at = np.concatenate(([0], np.cumsum(counts)))
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for words in words_of(batch.column("text")):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for d in range(words.documents):
                h = words.hashes[words.first[d] : words.first[d + 1]]
                for k in range(at[words.row + d], at[words.row + d + 1]):
                    place = int(fields["place"][k])
                    pos, high, low = place >> 8, place >> 4 & 15, place & 15
                    parts = [(low, high, int(fields["prefix"][k]))]
                    if fields["n"][k] > most:
                        own = [(o, h[pos - o : pos - o + WINDOW]) for o in range(low, high + 1)]
                        parts = [(o, o, int(mix(np.add.accumulate(mix(w + np.arange(WINDOW, dtype=U64)))[-1:] + U64(o)).view(np.int64)[0])) for o, w in own]
                    for a, b, prefix in parts:
                        for column, value in zip(out, (prefix, int(keys[words.row + d]), pos, a, b, h[pos - b : pos - a + WINDOW].tobytes())):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["prefix", "key", "pos", "low", "high", "words"])


def _depths(group: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """For each depth, the node at that depth under which each row lies: rows sorted by letters, cut where the common
    prefix with the row before is shorter."""
    order = np.lexsort((*letters.T[::-1], group))
    s, g = letters[order], group[order]
    common = np.zeros(len(order), np.int64)
    equal = np.cumprod(s[1:] == s[:-1], axis=1).sum(axis=1) if len(order) > 1 else np.zeros(0, np.int64)
    common[1:] = np.where(g[1:] == g[:-1], equal, -1)
    if len(common):
        common[0] = -1
    out = []
    for depth in range(letters.shape[1] + 1):
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(common < depth)
        out.append(node)
    return out


def repeated(group: np.ndarray, key: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mask of the offsets at which the window of each suffix has started earlier. before: words to the left, nearest first;
    after: words that follow the prefix."""
    left, right = _depths(group, before), _depths(group, after)
    mask = np.zeros(len(group), np.int64)
    for o in range(SPAN + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        a, b = right[SPAN - o][rows], left[o][rows]
        order = np.lexsort((pos[rows], key[rows], b, a))
        later = np.zeros(len(rows), bool)
        later[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        mask[rows[order[later]]] |= 1 << o
    return mask


def _matrix(packed: list[bytes], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.zeros((len(packed), SPAN), U64), np.zeros((len(packed), SPAN), U64)
    flat = np.frombuffer(b"".join(packed), U64)
    first = np.concatenate(([0], np.cumsum(high - low + WINDOW)))[:-1]
    for j in range(SPAN):
        some = high > j
        before[some, j] = flat[first[some] + high[some] - 1 - j]
        some = low <= SPAN - 1 - j
        after[some, j] = flat[first[some] + high[some] + PREFIX + j]
    return before, after


def _trees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Marks of all suffixes of a task; batches come sorted by prefix, key and pos."""
    held: list[pa.Table] = []
    size = 0

    def marks(key, pos, mask) -> pa.RecordBatch:
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(key[some], pa.int64()), pa.array(pos[some], pa.int32()), pa.array(mask[some], pa.int32())], ["key", "pos", "mask"])

    def columns(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        return [t.column(n).to_numpy() if isinstance(t, pa.Table) else t.column(n).to_numpy(zero_copy_only=False) for n in ("prefix", "key", "pos", "low", "high")]

    def flush() -> pa.RecordBatch:
        t = pa.concat_tables(held)
        prefix, key, pos, low, high = columns(t)
        group = np.cumsum(np.concatenate(([0], prefix[1:] != prefix[:-1])))
        return marks(key, pos, repeated(group, key, pos, low, high, *_matrix(t.column("words").to_pylist(), low, high)))

    for t in _bounded_runs(batches, most):
        if isinstance(t, tuple):  # a part of one window's group that goes on and on: its first suffix is the earliest
            first, part = t
            _, key, pos, low, high = columns(part)
            same = np.array([w == first for w in part.column("words").to_pylist()])
            yield marks(key, pos, np.where(same, _mask(low, high), 0))
            continue
        held.append(t)
        size += t.num_rows
        if size >= BATCH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _bounded_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table | tuple[bytes, pa.RecordBatch]]:
    """Groups of one prefix. Of a group far over ``most`` suffixes, which only a whole window's can be, the first part is a table
    and what follows comes piecewise with that window's words."""
    held: list[pa.RecordBatch] = []
    size, last, first = 0, None, None
    for batch in batches:
        prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
        if not len(prefix):
            continue
        cuts = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if prefix[a] != last:
                if held:
                    yield pa.Table.from_batches(held)
                held, size, last, first = [], 0, prefix[a], None
            part = batch.slice(a, b - a)
            if first is not None:
                yield first, part
                continue
            held.append(part)
            size += b - a
            if size > 2 * most:
                first = held[0].column("words")[0].as_py()
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _keep(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column("marks")
        counts = np.where(listed.is_valid().to_numpy(zero_copy_only=False), np.diff(listed.offsets.to_numpy()), 0)
        at = np.concatenate(([0], np.cumsum(counts)))
        flat = listed.flatten()
        pos, mask = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pos", "mask"))
        data, _ = text_buffer(batch.column("text"))
        total, removed, digest, kept = [], [], [], []
        for words in words_of(batch.column("text")):
            for d in range(words.documents):
                a, b = int(words.first[d]), int(words.first[d + 1])
                own = slice(at[words.row + d], at[words.row + d + 1])
                change = np.zeros(b - a + WINDOW + 1, np.int64)
                for o in range(SPAN + 1):
                    start = pos[own][(mask[own] >> o) & 1 == 1] - o
                    np.add.at(change, start, 1)
                    np.add.at(change, start + WINDOW, -1)
                left = np.flatnonzero(np.cumsum(change)[: b - a] == 0) + a
                sha, parts = hashlib.sha256(), []
                for low in range(0, len(left), 65536):
                    some = left[low : low + 65536]
                    part = b" ".join([data[s:e].tobytes() for s, e in zip(words.starts[some].tolist(), words.ends[some].tolist())])
                    part = b" " + part if low else part
                    sha.update(part)
                    if texts:
                        parts.append(part)
                total.append(b - a)
                removed.append(b - a - len(left))
                digest.append(sha.hexdigest())
                kept.append(b"".join(parts))
        columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key: one number for each row that orders them as the contract says. Where ids repeat or are null, rows
    are put in order once (null ids first, equal ids by text) and numbered by their place there, so any 64-bit id will do."""
    rows = docs.select("doc_id", "text")
    size = rows.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if (size["most"] or 1) == 1 and not size["nulls"]:
        return rows.select(F.col("doc_id").cast("bigint").alias("key"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text"))
    return placed.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")


def marks_of(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, pos, mask): for suffixes of the keyed documents, the offsets at which their windows are repeats."""
    made = docs.select("key", "text").mapInArrow(_suffixes, "kind int, prefix bigint, around bigint, key bigint, place bigint")
    pos = F.shiftright("place", 8).cast("int").alias("pos")
    whole = F.expr("shiftleft(2, cast(shiftright(place, 4) & 15 as int)) - shiftleft(1, cast(place & 15 as int))").alias("mask")
    dealt = made.where("kind = 0").drop("kind").repartition("prefix")
    alike = Window.partitionBy("prefix", "around").orderBy("key", "place")
    ranked = dealt.withColumn("rank", F.row_number().over(alike))
    ranked = ranked.withColumn("n", F.count_if(F.col("rank") == 1).over(Window.partitionBy("prefix")))
    leaves = (ranked.where((F.col("rank") == 1) & (F.col("n") > 1)).groupBy("key")
              .agg(F.collect_list(F.struct("place", "prefix", "n")).alias("suffixes")))
    around = docs.select("key", "text").join(leaves, "key").mapInArrow(lambda it: _leaves(it, group), "prefix bigint, key bigint, pos int, low int, high int, words binary")
    inner = around.repartition("prefix").sortWithinPartitions("prefix", "key", "pos").mapInArrow(lambda it: _trees(it, group), "key bigint, pos int, mask int")
    return made.where("kind = 1").select("key", pos, whole).unionByName(ranked.where("rank > 1").select("key", pos, whole)).unionByName(inner)


def without_repeats(docs: DataFrame, texts: bool = True, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the kept words joined by one space."""
    rows = _keyed(docs)
    marks = marks_of(rows, group).groupBy("key").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts
    return rows.join(marks, "key", "left").select("doc_id", "text", "marks").mapInArrow(lambda it: _keep(it, texts), schema)
