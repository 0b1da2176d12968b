"""Codes of vectors by product quantisation; codebooks from Lloyd rounds over members that stay with their owner.

Components are the integers floor(256 x). A vector is cut into equal consecutive parts; all rows of one (position, entry, salt) are
an owner's members, kept as packed blocks of parts. An owner sums its resident members, the sums of its salts give the new entry,
each member then looks for its nearest entry, and only members that change entry are shuffled to their new owner. Salts bound an
owner however many parts one entry attracts. What reaches the driver is one codebook: ``entries`` vectors.

Defined results: a vector that is null or has a null or non-finite component (also one whose 256-fold is not finite) is left out.
Vectors of another length than that of the smallest id are left out as well. A length that the number of parts does not divide is
filled up with zeros, which are no components of the digest. Rows of equal id are rows of their own; as first entries they follow
the order of their components; a null id comes after all others. With fewer vectors than entries the codebook is smaller.
Sums are exact for any finite input: doubles while every product fits in 53 bits, Python integers beyond; an error of more than
2^63 - 1 is given as that number. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MOST = (1 << 63) - 1
ROWS = 4096
#: Members of one owner, about; and the owners that one entry may have.
OWNED, SALTS = 100_000, 1024
_BLOCK = "position int, entry int, salt int, moved boolean, n long, kind string, data binary"
_NAMES = ["position", "entry", "salt", "moved", "n", "kind", "data"]


@dataclass(frozen=True)
class Codebook:
    """``parts`` arrays of entries x width. Integers are held as doubles where all of them are exact, else as Python objects."""

    books: list[np.ndarray]
    length: int

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def digest(self) -> str:
        taken, out = 0, []
        for book in self.books:
            own = max(0, min(self.width, self.length - taken))
            taken += self.width
            out.extend(str(int(v)) for entry in book for v in entry[:own])
        return hashlib.sha256(",".join(out).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles; doubles hold these integers exactly."""
    return np.floor(256.0 * x)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, members x entries."""
    width = parts.shape[1]
    most = max((float(np.abs(a.astype(float)).max()) for a in (parts, book) if a.size), default=0.0)
    if parts.dtype != object and book.dtype != object and 4.0 * width * most * most < 2.0**52:
        return (parts * parts).sum(1)[:, None] - 2.0 * (parts @ book.T) + (book * book).sum(1)[None, :]
    p, b = _objects(parts), _objects(book)
    out = np.empty((len(p), len(b)), object)
    for k, entry in enumerate(b):
        out[:, k] = ((p - entry) ** 2).sum(1) if width else 0
    return out


def _objects(a: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, object)
    out.ravel()[:] = [int(v) for v in a.ravel()]
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of equals, and its distance."""
    entry, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
    for low in range(0, len(parts), ROWS):
        d = distances(parts[low : low + ROWS], book)
        k = np.argmin(d, axis=1) if len(d) else np.zeros(0, np.int64)
        entry[low : low + ROWS], least[low : low + ROWS] = k, d[np.arange(len(d)), k]
    return entry, least


def pack(parts: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds the integers."""
    most = float(np.abs(parts).max()) if parts.size else 0.0
    kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
    return kind, np.ascontiguousarray(parts.astype(f"<{kind}")).tobytes()


def unpack(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the rows whose vector is whole and finite, components as doubles."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v * 256) == float("inf"))
    return vectors.select("vec_id", "label", x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", bad))


def first_codebook(rows: DataFrame, parts: int, entries: int) -> Codebook | None:
    """Parts of the vectors of the smallest ids. At most ``entries`` rows reach the driver."""
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    least = rows.orderBy(*order).select(F.size("x").alias("n")).first()
    if least is None:
        return None
    length = least["n"]
    first = [r["x"] for r in rows.where(F.size("x") == length).orderBy(*order).select("x").limit(entries).collect()]
    whole = cut(np.array(first, float).reshape(len(first), length), parts)
    return Codebook([integers(whole[:, k]) for k in range(parts)], length)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """vectors x parts x width, filled up with zeros."""
    width = max(1, -(-x.shape[1] // parts))
    full = np.zeros((len(x), parts * width))
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), parts, width)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), length)


def _blocks(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=_NAMES)


def _split(position: int, parts: np.ndarray, entry: np.ndarray, spread: int, salts: int, moved: bool) -> Iterator[tuple]:
    """One block for each entry; a block's salt follows from where it was made."""
    order = np.argsort(entry, kind="stable")
    parts, entry = parts[order], entry[order]
    cuts = np.flatnonzero(np.diff(entry)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(entry)]):
        if high > low:
            yield position, int(entry[low]), spread % salts, moved, high - low, *pack(parts[low:high])


def _dealt(length: int, parts: int, book, salts: int):
    """Blocks of the members of each entry of the first codebook."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook, spread = cloudpickle.loads(book.value), TaskContext.get().partitionId() * 7919
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                x = integers(cut(_matrix(batch.column(0).slice(low, ROWS), length), parts))
                spread += 1
                out = [b for k in range(parts) for b in _split(k, x[:, k], nearest(x[:, k], codebook.books[k])[0], spread, salts, False)]
                if out:
                    yield _blocks(out)
    return run


def _moved(book, salts: int):
    """Residents stay in their block; members that another entry is nearer to leave in blocks of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook, spread = cloudpickle.loads(book.value), TaskContext.get().partitionId() * 7919
        for batch in batches:
            for r in batch.to_pylist():
                members = unpack(r["kind"], r["data"], r["n"])
                entry, _ = nearest(members, codebook.books[r["position"]])
                stay, spread, out = entry == r["entry"], spread + 1, []
                if stay.any():
                    out.append((r["position"], r["entry"], r["salt"], False, int(stay.sum()), *pack(members[stay])))
                out.extend(_split(r["position"], members[~stay], entry[~stay], spread, salts, True))
                yield _blocks(out)
    return run


def _owner_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of the resident members by (position, entry), as decimal text; one row a pair and task."""
    sums: dict[tuple[int, int], list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            members = unpack(r["kind"], r["data"], r["n"])
            small = r["kind"] != "f8"
            own = members.astype(np.int64).sum(0).tolist() if small else _objects(members).sum(0).tolist()
            at = sums.setdefault((r["position"], r["entry"]), [0, [0] * len(own)])
            at[0] += r["n"]
            at[1] = [a + b for a, b in zip(at[1], own)]
    if sums:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([list(map(str, sums[k][1])) for k in keys], pa.list_(pa.string()))],
            names=["position", "entry", "n", "sums"])


def _entry_mean(rows: pa.Table) -> pa.Table:
    """floor(sum / count) of one entry, over the sums of its owners."""
    n = sum(rows["n"].to_pylist())
    total = [sum(map(int, c)) for c in zip(*rows["sums"].to_pylist())]
    return pa.table({"position": rows["position"][:1], "entry": rows["entry"][:1], "mean": pa.array([[str(t // n) for t in total]], pa.list_(pa.string()))})


def _updated(members: DataFrame, codebook: Codebook) -> Codebook:
    """Entries replaced by the floor of their members' mean; entries without members stay."""
    sums = members.mapInArrow(_owner_sums, "position int, entry int, n long, sums array<string>")
    means = sums.groupBy("position", "entry").applyInArrow(_entry_mean, "position int, entry int, mean array<string>")
    books = [b.copy() for b in codebook.books]
    for r in means.collect():  # parts x entries rows at most
        mean = [int(v) for v in r["mean"]]
        book = books[r["position"]]
        if book.dtype != object and any(abs(v) > 2**53 and int(float(v)) != v for v in mean):
            book = books[r["position"]] = _objects(book)
        book[r["entry"]] = mean
    return Codebook(books, codebook.length)


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebook | None:
    """The codebooks after ``rounds`` of assigning members and replacing entries; None if no vector is kept."""
    rows = kept(vectors)
    codebook = first_codebook(rows, parts, entries)
    if codebook is None or rounds < 1:
        return codebook
    context = vectors.sparkSession.sparkContext
    rows = rows.where(F.size("x") == codebook.length).select("x")
    salts = int(min(SALTS, rows.count() // (OWNED * entries // 8) + 8))  # an entry may attract many times its share
    sent = context.broadcast(cloudpickle.dumps(codebook))  # its class by value
    dealt = rows.mapInArrow(_dealt(codebook.length, parts, sent, salts), _BLOCK)
    members = cut_lineage(dealt.repartition("position", "entry", "salt"))
    sent.unpersist()
    for k in range(rounds):
        codebook = _updated(members, codebook)
        if k + 1 < rounds:
            sent = context.broadcast(cloudpickle.dumps(codebook))  # its class by value
            seen = cut_lineage(members.mapInArrow(_moved(sent, salts), _BLOCK))
            sent.unpersist()
            members = seen.where(~F.col("moved")).unionByName(seen.where("moved").repartition("position", "entry", "salt"))
    return codebook


def _coded(book, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = cloudpickle.loads(book.value)
        digits = -(-(max(len(b) for b in codebook.books) - 1).bit_length() // 4)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = batch.slice(low, ROWS)
                x = integers(cut(_matrix(piece.column(2), codebook.length), len(codebook.books)))
                found = [nearest(x[:, k], b) for k, b in enumerate(codebook.books)]
                code = ["".join(f"{int(v):0{max(2, digits)}x}" for v in c) for c in zip(*(e for e, _ in found))]
                error = [min(MOST, int(sum(map(int, d)))) for d in zip(*(d for _, d in found))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                                 names=["vec_id", "label", "code", "error"])
    return run


def encode(vectors: DataFrame, codebook: Codebook) -> DataFrame:
    """(vec_id, label, code, error): indexes of the nearest entries in part order, two hex digits each (more beyond 256 entries),
    and the squared distances summed over the parts. No shuffle."""
    rows = kept(vectors).where(F.size("x") == codebook.length)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    sent = vectors.sparkSession.sparkContext.broadcast(cloudpickle.dumps(codebook))
    return rows.mapInArrow(_coded(sent, codebook.width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def code_report(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector; label_error sums over rows of equal label."""
    codebook = train(vectors, parts, entries, rounds)
    kind = dict(vectors.dtypes)
    if codebook is None:
        return vectors.where(F.lit(False)).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = cut_lineage(encode(vectors, codebook))
    salts = 16  # rows of one label meet its sum in as many places
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    total = total.select(F.col("label").alias("l"), F.least("s", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("z"))
    salted = coded.withColumn("z", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return salted.join(total, salted["label"].eqNullSafe(total["l"]) & (salted["z"] == total["z"]), "left").select(
        F.col("vec_id").cast(kind["vec_id"]).alias("vec_id"), "code", "error", "label_error", F.lit(codebook.digest()).alias("codebooks_sha256"))
