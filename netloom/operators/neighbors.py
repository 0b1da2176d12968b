"""Nearest neighbours, neighbour graphs and low-rank embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .correlation import dense_vectors
from .normalize import binarize, tf_idf

BLOCK = 4096
KEY_BLOCK = 512
PIVOTS, CELL_ROWS, RINGS, RING_ROWS = 1024, 2048, 16, 2048
NEAR_TILE = 16
BUNDLE_ROWS = 2**16  # keys of a task


def nearest_neighbors(vectors: DataFrame, k: int, key_block: int = KEY_BLOCK, block: int = BLOCK, cell_rows: int = CELL_ROWS, ring_rows: int = RING_ROWS) -> DataFrame:
    """The ``k`` nearest other cells by Euclidean distance: (cell_id, other, distance, rank); equal distances go to the lower id.

    Exact, over a metric partition.  Rows are dealt to the nearest of at most ``PIVOTS`` pivots and, by their distance from it,
    to a ring.  Keys first take an upper bound of their k-th distance from one block of their own ring; by the triangle
    inequality only rings that a ball of that radius meets can hold a nearer cell, and only their members are sent to the keys'
    block, which holds its current best ``k`` while they stream by.  Blocks of keys share a task, at most 4 a core and as many as
    ``BUNDLE_ROWS`` keys call for, and a member block is sent once to each task, with the key blocks that asked for it.  Pivots and ring edges are all that is broadcast; large rings
    are cut into blocks, so a dense spot is many tasks.  No pair of cells is ever a row.
    """
    rows = vectors.select("cell_id", F.col("v").cast("array<double>").alias("v"))
    placed, pivots, radius, rings = _placed(rows, cell_rows, ring_rows)
    if placed is None:
        return rows.sparkSession.createDataFrame([], "cell_id bigint, other bigint, distance double, rank int")
    held = F.broadcast(placed.groupBy("_c", "_ring").agg(F.count(F.lit(1)).alias("_held")))  # at most PIVOTS x RINGS rows
    sized = placed.join(held, ["_c", "_ring"])
    cut = lambda size, seed: F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.ceil(F.col("_held") / F.lit(size))).cast("int")
    keys = cut_lineage(sized.groupBy("_c", "_ring", cut(key_block, 1).alias("_ks")).agg(F.collect_list(F.struct("cell_id", "v")).alias("_r"), F.first("_held").alias("_held")).select(
        F.concat_ws("-", "_c", "_ring", "_ks").alias("_kb"), "_c", "_ring", "_ks", "_held", F.col("_r.cell_id").alias("key_id"), F.flatten("_r.v").alias("key_v")))
    members = cut_lineage(sized.groupBy("_c", "_ring", cut(block, 2).alias("_ms")).agg(F.collect_list(F.struct("cell_id", "v")).alias("_r"), F.first("_held").alias("_held")).select(
        "_c", "_ring", "_ms", "_held", F.col("_r.cell_id").alias("id"), F.flatten("_r.v").alias("v")))
    own = keys.withColumn("_ms", F.pmod("_ks", F.ceil(F.col("_held") / F.lit(block))).cast("int"))
    bounded = own.join(members.drop("_held"), ["_c", "_ring", "_ms"], "left").select("_kb", "key_id", "key_v", "id", "v")
    asks = bounded.mapInArrow(_open_rings(pivots, radius, rings, k), "_kb string, _c int, _ring int")
    blocks = members.select("_c", "_ring", "_held").distinct().withColumn("_ms", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_held") / F.lit(block)).cast("int") - 1)))
    asked = asks.join(F.broadcast(blocks.groupBy("_c", "_ring").agg(F.collect_list("_ms").alias("_m"))), ["_c", "_ring"]).select("_kb", "_c", "_ring", F.explode("_m").alias("_ms"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    bundle = F.pmod(F.xxhash64("_kb"), F.lit(max(4 * cores, -(-placed.count() // BUNDLE_ROWS))))
    sent = _sent(asked.withColumn("_kg", bundle), members)
    both = keys.select(bundle.alias("_kg"), "_kb", "key_id", "key_v").unionByName(sent, allowMissingColumns=True).repartition(4 * cores, "_kg")
    return both.sortWithinPartitions("_kg", F.col("_kb").isNull()).groupBy("_kg").applyInArrow(_best(k), "cell_id bigint, other bigint, distance double, rank int")


def _sent(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Every member block once for each task (_kg) in which key blocks ask for it, with their names."""
    once = asked.groupBy("_kg", "_c", "_ring", "_ms").agg(F.collect_list("_kb").alias("_asks"))
    return once.join(members.hint("merge"), ["_c", "_ring", "_ms"]).select("_kg", "_asks", "id", "v")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by products, with a relative error of about 1e-12 of the vectors' squares."""
    square = (x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than the rounding error of ``_distances``: near 0 it is the root of that of the squares."""
    most = max(float((a * a).sum(1).max(initial=0.0)) for a in (x, y))
    return 1e-6 * np.sqrt(most) + 1e-150


def _placed(rows: DataFrame, cell_rows: int, ring_rows: int):
    """Rows with their pivot ``_c`` and ring, and the pivots, radii and rings of the pivots' cells."""
    n = rows.count()
    if not n:
        return None, None, None, None
    few = rows.orderBy(F.xxhash64("cell_id"), "cell_id").limit(max(1, min(PIVOTS, n // cell_rows))).select("v").collect()
    pivots = np.array([r["v"] for r in few], float).reshape(len(few), -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            d = _distances(x, pivots)
            c = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("v"), pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], ["cell_id", "v", "_c", "_d"])

    near = cut_lineage(rows.mapInArrow(deal, "cell_id bigint, v array<double>, _c int, _d double"))
    facts = near.groupBy("_c").agg(F.max("_d").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # one row a pivot
    radius, rings = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)
    for f in facts:
        radius[f["_c"]], rings[f["_c"]] = f["r"], min(RINGS, -(-f["n"] // ring_rows))
    edge = lambda values: F.get(F.array(*map(F.lit, values)), F.col("_c"))
    share = F.when(edge(radius.tolist()) > 0, F.col("_d") / edge(radius.tolist())).otherwise(F.lit(0.0))
    ring = F.least(F.floor(share * edge(rings.tolist())), edge(rings.tolist()) - 1).cast("int")
    return near.withColumn("_ring", ring).drop("_d"), pivots, radius, rings


def _open_rings(pivots: np.ndarray, radius: np.ndarray, rings: np.ndarray, k: int):
    """For each block of keys, next to one block of its own ring: the rings that may hold one of the k nearest."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flat = lambda c: batch.column(c)[row].values.to_numpy()
                ids = flat("key_id")
                x = flat("key_v").reshape(len(ids), -1)
                other, y = (flat("id"), flat("v").reshape(-1, x.shape[1])) if batch.column("id")[row].is_valid else (ids[:0], x[:0])
                near = _distances(x, y)
                near[ids[:, None] == other[None, :]] = np.inf
                bound = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(x), np.inf)
                bound = bound + _slack(x, np.vstack([y, pivots]))
                d = _distances(x, pivots)
                width = np.where(radius > 0, rings / np.where(radius > 0, radius, 1.0), 0.0)
                with np.errstate(invalid="ignore"):
                    low = np.floor(np.nan_to_num((d - bound[:, None]) * width, nan=0.0, neginf=-1.0, posinf=1e9))
                    high = np.floor(np.nan_to_num((d + bound[:, None]) * width, nan=0.0, posinf=1e9))
                low, high = np.clip(low, 0, None), np.minimum(high, rings - 1)
                meets = d - bound[:, None] <= radius + _slack(x, pivots)
                low = np.minimum(low, rings - 1)  # the outermost ring holds its own edge
                cells, where = [], []
                for r in range(int(rings.max())):
                    hit = np.flatnonzero((meets & (low <= r) & (r <= high)).any(axis=0))
                    cells.append(hit)
                    where.append(np.full(len(hit), r))
                cells, where = np.concatenate(cells).astype(np.int32), np.concatenate(where).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("_kb")[row].as_py()] * len(cells), pa.string()), pa.array(cells), pa.array(where)], ["_kb", "_c", "_ring"])
    return task


def _best(k: int):
    """Best ``k`` of blocks of keys while blocks of members stream by: products find candidates, differences decide."""
    def closer(ids: np.ndarray, x: np.ndarray, best: tuple, other: np.ndarray, y: np.ndarray) -> tuple:
        slack = _slack(x, y)
        held, of, _ = best
        bound = np.full(len(ids), np.inf)
        ends = np.searchsorted(of, np.arange(len(ids)), "right")
        full = ends - np.searchsorted(of, np.arange(len(ids))) >= k
        bound[full] = held[ends[full] - 1]
        squares = (y * y).sum(1)
        found = [(of, held, best[2])]
        for low in range(0, len(ids), NEAR_TILE):
            tile, most = x[low : low + NEAR_TILE], bound[low : low + NEAR_TILE]
            if np.isfinite(most).all():  # squares do, and the few that are near enough tell whether they are the key itself
                at, col = np.nonzero(squares - (2.0 * tile) @ y.T <= ((most + 2 * slack) ** 2 - (tile * tile).sum(1))[:, None])
                apart = ids[at + low] != other[col]
                at, col = at[apart], col[apart]
            else:
                near = _distances(tile, y)
                near[ids[low : low + NEAR_TILE, None] == other[None, :]] = np.inf
                most = np.minimum(most, np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1])
                at, col = np.nonzero((near <= most[:, None] + 2 * slack) & np.isfinite(near))
            found.append((at + low, np.sqrt(((tile[at] - y[col]) ** 2).sum(axis=1)), other[col]))
        at, distance, other = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((other, distance, at))
        at, distance, other = at[order], distance[order], other[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        return distance[keep], at[keep], other[keep]

    def task(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                flat = lambda c: batch.column(c)[row].values.to_numpy()
                if batch.column("_kb")[row].is_valid:
                    ids = flat("key_id")
                    held[batch.column("_kb")[row].as_py()] = ids, flat("key_v").reshape(len(ids), -1), (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
                    continue
                other = flat("id")
                y = flat("v").reshape(len(other), -1)
                for name in batch.column("_asks")[row].as_py():
                    ids, x, best = held[name]
                    held[name] = ids, x, closer(ids, x, best, other, y)
        for ids, _, (distance, at, other) in held.values():
            rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(other), pa.array(distance), pa.array(rank.astype(np.int32))], ["cell_id", "other", "distance", "rank"])

    return task


def neighbor_graph(neighbors: DataFrame, cells: DataFrame) -> DataFrame:
    """Symmetric neighbour graph with self loops, rows scaled to sum 1: (cell_id, other, weight)."""
    arcs = neighbors.select("cell_id", "other")
    flipped = arcs.select(F.col("other").alias("cell_id"), F.col("cell_id").alias("other"))
    loops = cells.select("cell_id", F.col("cell_id").alias("other"))
    linked = arcs.unionByName(flipped).unionByName(loops).distinct()
    return linked.join(linked.groupBy("cell_id").agg((1.0 / F.count(F.lit(1))).alias("weight")), "cell_id")


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """Scores on the first ``k`` components of the centred data."""
    mean = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")) \
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_m")).select(F.col("_m.m").alias("_m"))
    centred = vectors.withColumn("_m", mean.scalar()).select(
        "cell_id", array_to_vector(F.zip_with(F.col("v").cast("array<double>"), "_m", lambda x, m: x - m)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="p").fit(centred)
    return model.transform(centred).select("cell_id", vector_to_array("p").alias("v"))


def truncated_svd(vectors: DataFrame, k: int) -> DataFrame:
    """Left singular vectors times singular values of the uncentred data."""
    column = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("x"))
    right = RowMatrix(MLUtils.convertVectorColumnsFromML(column, "x")).computeSVD(k).V.toArray()
    # Scores are the rows times the right singular vectors; those are columns x k numbers.
    axes = vectors.sparkSession.createDataFrame([(right.T.tolist(),)], "a array<array<double>>").scalar()
    dot = lambda axis: F.aggregate(F.zip_with(F.col("v").cast("array<double>"), axis, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return vectors.withColumn("_axes", axes).select("cell_id", F.transform("_axes", dot).alias("v"))


def shared_neighbors(expression: DataFrame, access: DataFrame, n_features: int, k: int, first_k: int, second_k: int) -> DataFrame:
    """Neighbour graph over two modalities' embeddings put side by side: (cell_id, other, weight).

    ``expression`` is (cell_id, v), ``access`` sparse counts (cell_id, feature_id from 0, count), which count as present or
    absent and are weighted by term share and rarity.  Cells without access stand at the origin of the second embedding.
    """
    ends = lambda most, width: max(1, min(most, width))
    cells = expression.select("cell_id")
    weighted = tf_idf(binarize(access.filter("count <> 0").join(cells, "cell_id", "left_semi")), cells.count()).select(F.lit(0).alias("_g"), "cell_id", "feature_id", "weight")
    a = principal_components(expression, first_k).withColumnRenamed("v", "_a")
    filled = dense_vectors(weighted, "cell_id", "feature_id", "weight", n_features, "_g").select("cell_id", "v")
    width = ends(second_k, n_features)
    b = truncated_svd(filled, width).withColumnRenamed("v", "_b")
    none = F.array_repeat(F.lit(0.0), width)
    both = cut_lineage(a.join(b, "cell_id", "left").select("cell_id", F.concat("_a", F.coalesce("_b", none)).alias("v")))
    return neighbor_graph(nearest_neighbors(both, k), both.select("cell_id"))


def _nonnegative_rows(g: np.ndarray, b: np.ndarray, sweeps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Rows w >= 0 of least w g w' / 2 - w b', by coordinate descent over all rows at once."""
    w = np.zeros_like(b)
    usable = np.flatnonzero(np.diag(g) > 0)
    for _ in range(sweeps):
        moved = 0.0
        for c in usable:
            better = np.maximum(0.0, w[:, c] + (b[:, c] - w @ g[:, c]) / g[c, c])
            moved = max(moved, float(np.abs(better - w[:, c]).max(initial=0.0)))
            w[:, c] = better
        if moved <= tolerance * max(1.0, float(w.max(initial=0.0))):
            break
    return w


def nonnegative_factors(values: DataFrame, k: int, iterations: int = 500, seed: int = 42, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of a long matrix: cells (cell_id, v) and genes (gene, v); absent values are 0.

    Alternating non-negative least squares until an iteration lowers the squared error by less than ``tolerance``
    of the first one's.  The weights of a cell depend on its own row and the genes' factors only, so a pass needs
    no state of the one before: tasks add up k x (genes + k) sums, the driver holds genes x k numbers.
    """
    spark = values.sparkSession
    n = (values.agg(F.max("gene")).first()[0] or 0) + 1
    rows = cut_lineage(dense_vectors(values.withColumn("_g", F.lit(0)), "cell_id", "gene", "value", n, "_g").select("cell_id", "v"))
    scale = np.sqrt(max(rows.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda t, x: t + x))).first()[0] or 0.0, 0.0) / n / k)
    genes = scale * np.abs(np.random.default_rng(seed).normal(size=(n, k)))

    def weights(batch: pa.RecordBatch, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
        return x, _nonnegative_rows(h.T @ h, x @ h)

    def sums(h: np.ndarray):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + n))
            error = 0.0
            for batch in batches:
                x, w = weights(batch, h)
                total += w.T @ np.hstack([w, x])
                error += float(((x - w @ h.T) ** 2).sum())
            yield pa.RecordBatch.from_pydict({"v": [np.append(total.ravel(), error)]})
        return task

    def place(h: np.ndarray):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"cell_id": batch.column("cell_id"), "v": list(weights(batch, h)[1])})
        return task

    first = last = None
    for _ in range(iterations):
        added = rows.mapInArrow(sums(genes), "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        flat = np.array([r["x"] for r in added.orderBy("i").collect()])  # k x (genes + k) numbers, whatever the cells
        if not len(flat):
            break
        products, error = flat[:-1].reshape(k, k + n), flat[-1]
        genes = _nonnegative_rows(products[:, :k], products[:, k:].T)
        first = error if first is None else first
        if last is not None and last - error <= tolerance * first:
            break
        last = error
    cells = rows.mapInArrow(place(genes), "cell_id bigint, v array<double>")
    factors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(genes)], "gene int, v array<double>")
    return cells, factors
