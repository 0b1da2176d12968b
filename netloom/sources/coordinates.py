"""Sparse matrices in coordinate or column-compressed folders as a Spark data source.

``spark.read.format("coordinates").option("table", t).load(folder)`` with t = counts, features or barcodes.  A folder holds
features.tsv (gene id, name, feature type and, where given, chromosome, start, end), barcodes.tsv and the matrix (features x cells):

    matrix.mtx                            one-based ``feature cell count`` lines after the comments and the shape
    data.npy, indices.npy, indptr.npy     counts and zero-based features of each cell's column

Counts are read in partitions that each own a range of the file: lines that begin in a byte range, or columns of a range, so every
entry is read once and nothing but the shape is read to plan.  A filter on ``feature_type`` (= or in) reaches the reader, which
keeps a flag per feature; other entries are dropped before they become rows.  Ids count from 1 in file order.
"""

from __future__ import annotations

import ast
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

SCHEMAS = {
    "counts": "cell_id bigint, feature_id bigint, count double, feature_type string",
    "features": "feature_id bigint, name string, gene_id string, feature_type string, interval string, ordinal bigint",
    "barcodes": "cell_id bigint, barcode string",
}
ROWS = 50_000


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    folder = re.sub(r"^s3[an]:", "s3:", folder.rstrip("/"))
    if folder.startswith("file:"):
        folder = re.sub(r"^file:/*", "/", folder)
    return pa.fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9+]+:", folder) else (pa.fs.LocalFileSystem(), os.path.abspath(folder))


def _lines(fs, path: str) -> Iterator[list[str]]:
    rest = b""
    with fs.open_input_stream(path) as f:
        while chunk := f.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                yield line.decode("utf-8").rstrip("\r").split("\t")
    if rest:
        yield rest.decode("utf-8").rstrip("\r").split("\t")


@dataclass
class Range(InputPartition):
    low: int
    high: int

    def __post_init__(self):
        super().__init__(None)


class _Npy:
    """One-dimensional .npy array read a range at a time."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        major = self.file.read(8)[6]
        size = struct.unpack("<H" if major == 1 else "<I", self.file.read(2 if major == 1 else 4))[0]
        head = ast.literal_eval(self.file.read(size).decode("latin-1"))
        self.kind, (self.length,), self.start = np.dtype(head["descr"]), head["shape"], self.file.tell()

    def read(self, low: int, high: int) -> np.ndarray:
        self.file.seek(self.start + low * self.kind.itemsize)
        return np.frombuffer(self.file.read((high - low) * self.kind.itemsize), self.kind)


class CoordinateReader(DataSourceReader):
    def __init__(self, folder: str, table: str, names: list[str], part: int):
        self.folder, self.table, self.names, self.part = folder, table, names, part
        self.types: set[str] | None = None
        self.typed = False

    def pushFilters(self, filters):
        for f in filters:
            if self.table == "counts" and isinstance(f, (EqualTo, In)) and f.attribute == ("feature_type",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = wanted if self.types is None else self.types & wanted
            elif self.table == "counts" and isinstance(f, IsNotNull) and f.attribute == ("feature_type",):
                self.typed = True
            else:
                yield f

    def partitions(self):
        if self.table != "counts":
            return [Range(0, 0)]
        fs, root = _file_system(self.folder)
        if fs.get_file_info(f"{root}/matrix.mtx").type == pa.fs.FileType.File:
            whole = fs.get_file_info(f"{root}/matrix.mtx").size
        else:
            whole = max(0, _Npy(fs, f"{root}/indptr.npy").length - 1)
        return [Range(low, min(low + self.part, whole)) for low in range(0, whole, self.part)] or [Range(0, 0)]

    def read(self, partition: Range):
        fs, root = _file_system(self.folder)
        if self.table == "features":
            yield from self._named((i, f[1] if len(f) > 1 else f[0], f[0], f[2] if len(f) > 2 else None,
                                    f"{f[3]}:{f[4]}-{f[5]}" if len(f) > 5 else None, i) for i, f in enumerate(_lines(fs, f"{root}/features.tsv"), 1))
        elif self.table == "barcodes":
            yield from self._named((i, f[0]) for i, f in enumerate(_lines(fs, f"{root}/barcodes.tsv"), 1))
        else:
            types = [f[2] if len(f) > 2 else None for f in _lines(fs, f"{root}/features.tsv")]
            asked = lambda t: t is not None and (self.types is None or t in self.types)
            kept = np.array([asked(t) for t in types], bool) if self.typed or self.types is not None else None
            labels = pa.array(types, pa.string())
            plain = fs.get_file_info(f"{root}/matrix.mtx").type == pa.fs.FileType.File
            for cells, features, values in self._coordinate(fs, root, partition) if plain else self._columns(fs, root, partition):
                if kept is not None:
                    own = kept[features]
                    cells, features, values = cells[own], features[own], values[own]
                for low in range(0, len(cells), ROWS):
                    at = slice(low, low + ROWS)
                    found = {"cell_id": pa.array(cells[at] + 1), "feature_id": pa.array(features[at] + 1), "count": pa.array(values[at].astype(float)), "feature_type": labels.take(pa.array(features[at]))}
                    yield pa.RecordBatch.from_arrays([found[n] for n in self.names], names=self.names)

    def _named(self, rows) -> Iterator[pa.RecordBatch]:
        kinds = {name: pa.int64() if kind == "bigint" else pa.string() for name, kind in (c.split() for c in SCHEMAS[self.table].split(", "))}
        rows = list(rows)
        columns = dict(zip(kinds, zip(*rows))) if rows else {n: () for n in kinds}
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) for n in self.names], names=self.names)

    def _coordinate(self, fs, root: str, part: Range):
        """Zero-based entries of the lines that begin in the byte range; the shape is the first line that is no comment."""
        with fs.open_input_file(f"{root}/matrix.mtx") as f:
            head = b""
            while not (body := [x for x in head.split(b"\n")[:-1] if not x.startswith(b"%")]):
                more = f.read(1 << 16)
                if not more:
                    return
                head += more
            begin = max(part.low, head.index(b"\n" + body[0] + b"\n") + 1 + len(body[0]) + 1 if not head.startswith(body[0]) else len(body[0]) + 1)
            if begin > part.low:
                f.seek(begin)
            else:  # a line that began before belongs to the range before
                f.seek(begin - 1)
                skipped = b""
                while b"\n" not in skipped:
                    more = f.read(1 << 12)
                    if not more:
                        return
                    skipped += more
                begin += skipped.index(b"\n")
                f.seek(begin)
            at, rest = begin, b""
            while at < part.high and (chunk := f.read(1 << 20)):
                *whole, last = (rest + chunk).split(b"\n")
                taken = []
                for line in whole:
                    if at >= part.high:
                        break
                    taken.append(line)
                    at += len(line) + 1
                rest = last if at < part.high else b""
                yield self._parsed(taken)
            if rest and at < part.high:  # the last line of the file has no end mark
                yield self._parsed([rest])

    @staticmethod
    def _parsed(lines: list[bytes]):
        fields = np.array(b" ".join(lines).split(), float).reshape(-1, 3)
        return fields[:, 1].astype(np.int64) - 1, fields[:, 0].astype(np.int64) - 1, fields[:, 2]

    def _columns(self, fs, root: str, part: Range):
        if part.high <= part.low:
            return
        ends = _Npy(fs, f"{root}/indptr.npy").read(part.low, part.high + 1).astype(np.int64)
        data, indices = _Npy(fs, f"{root}/data.npy"), _Npy(fs, f"{root}/indices.npy")
        step = 1 << 20
        for low in range(int(ends[0]), int(ends[-1]), step):
            high = min(low + step, int(ends[-1]))
            cells = part.low + np.searchsorted(ends, np.arange(low, high), "right") - 1
            yield cells.astype(np.int64), indices.read(low, high).astype(np.int64), data.read(low, high)


class CoordinateSource(DataSource):
    """Options: table (counts, features, barcodes), part: bytes of a matrix.mtx or columns of a compressed matrix in one partition."""

    @classmethod
    def name(cls) -> str:
        return "coordinates"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "counts")]

    def reader(self, schema: StructType) -> CoordinateReader:
        part = self.options.get("part")
        if part is None:
            fs, root = _file_system(self.options["path"])
            plain = fs.get_file_info(f"{root}/matrix.mtx").type == pa.fs.FileType.File
            part = 64 << 20 if plain else 20_000
        return CoordinateReader(self.options["path"], self.options.get("table", "counts"), schema.names, int(part))


def read_table(spark: SparkSession, folder: str, table: str, part: int | None = None) -> DataFrame:
    """A table of the folder, loaded anew: branches of one plan that filter differently need a load each."""
    spark.dataSource.register(CoordinateSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("coordinates").option("table", table)
    return (reader if part is None else reader.option("part", part)).load(folder)
