"""The coordinate source against entries held in memory."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.sources import coordinates, files

TYPES = ["Gene Expression"] * 5 + ["Peaks"] * 4


def folder(path, entries, cells, kind, comment="%%MatrixMarket matrix coordinate real general\n%\n", end="\n"):
    path.mkdir(parents=True, exist_ok=True)
    (path / "features.tsv").write_text("".join(f"E{i}\tG{i}\t{t}\tchr1\t{i}\t{i + 9}\n" for i, t in enumerate(TYPES)))
    (path / "barcodes.tsv").write_text("\n".join(f"b{i}" for i in range(cells)))
    if kind == "mtx":
        lines = [f"{f + 1} {c + 1} {v:g}" for c, f, v in entries]
        (path / "matrix.mtx").write_text(comment + f"{len(TYPES)} {cells} {len(entries)}\n" + "\n".join(lines) + end * bool(lines))
    else:
        order = sorted(entries)
        np.save(path / "data.npy", np.array([v for *_, v in order], np.float32))
        np.save(path / "indices.npy", np.array([f for _, f, _ in order], np.int32))
        np.save(path / "indptr.npy", np.searchsorted([c for c, *_ in order], np.arange(cells + 1)).astype(np.int64))
    return str(path)


@pytest.mark.parametrize("kind", ["mtx", "columns"])
def test_every_entry_is_read_once(spark, tmp_path, kind):
    rnd = random.Random(4)
    entries = [(c, f, float(rnd.choice([1, 2, 30]))) for c in range(40) for f in range(9) if c % 7 and rnd.random() < 0.4]
    rnd.shuffle(entries)
    at = folder(tmp_path / kind, entries, 40, kind)
    for part in (1, 3, 17, 64, 10**6):
        reader = coordinates.CoordinateReader(at, "counts", ["cell_id", "feature_id", "count"], part)
        got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(got) == sorted((c + 1, f + 1, v) for c, f, v in entries), part
    counts = coordinates.read_table(spark, f"file://{at}", "counts", 50 if kind == "mtx" else 9)
    assert counts.rdd.getNumPartitions() > 3
    peaks = counts.filter("feature_type = 'Peaks'")
    assert " Filter " not in peaks._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["cell_id"], r["feature_id"]) for r in peaks.collect()) == sorted((c + 1, f + 1) for c, f, _ in entries if f >= 5)
    assert coordinates.read_table(spark, at, "counts").filter(F.col("feature_type").isin("x", "Gene Expression")).count() == sum(f < 5 for _, f, _ in entries)
    loaded, listed, cells = files.read_coordinates(spark, at)
    assert loaded.count() == len(entries) and cells.count() == 40
    assert [tuple(r) for r in listed.orderBy("feature_id").limit(1).collect()] == [(1, "G0", "E0", "Gene Expression", "chr1:0-9", 1)]


def test_odd_files(spark, tmp_path):
    assert coordinates.read_table(spark, folder(tmp_path / "none", [], 3, "mtx"), "counts").count() == 0
    assert coordinates.read_table(spark, folder(tmp_path / "void", [], 0, "columns"), "counts").count() == 0
    bare = folder(tmp_path / "bare", [(0, 1, 2.0), (1, 8, 1.5)], 2, "mtx", comment="", end="")
    for part in (1, 5, 100):
        assert sorted((r["cell_id"], r["feature_id"], r["count"]) for r in coordinates.read_table(spark, bare, "counts", part).collect()) == [(1, 2, 2.0), (2, 9, 1.5)]
