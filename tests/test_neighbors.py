"""Nearest neighbours over the metric partition against all pairs."""

import numpy as np
import pytest

from netloom.operators import neighbors


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "cell_id bigint, v array<double>").repartition(4)


def brute(x, ids, k):
    out = {}
    for i, row in zip(ids, x):
        d = np.sqrt(((x - row) ** 2).sum(1))
        order = sorted((dist, j) for dist, j in zip(d, ids) if j != i)[:k]
        out[i] = [(j, r + 1, round(dist, 9)) for r, (dist, j) in enumerate(order)]
    return out


def got(df):
    out = {}
    for r in df.orderBy("cell_id", "rank").collect():
        out.setdefault(r["cell_id"], []).append((r["other"], r["rank"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("kind", ["clusters", "even", "copies"])
def test_exact_for_any_shape_of_data(spark, kind):
    rng = np.random.default_rng(3)
    x = {"clusters": rng.normal(size=(400, 3)) * 0.05 + rng.integers(0, 6, size=(400, 1)) * 10.0,
         "even": rng.normal(size=(400, 8)), "copies": np.repeat(rng.normal(size=(8, 4)), 50, axis=0)}[kind]
    x[0] = 1000.0
    ids = rng.permutation(10**6)[:400].tolist()
    for k in (1, 7):
        assert got(neighbors.nearest_neighbors(table(spark, x, ids), k, key_block=16, block=40, cell_rows=40, ring_rows=20)) == brute(x, ids, k)


def test_few_rows(spark):
    x = np.arange(6.0)[:, None]
    assert got(neighbors.nearest_neighbors(table(spark, x), 9)) == brute(x, range(6), 9)
    assert got(neighbors.nearest_neighbors(table(spark, x[:1]), 3)) == {}
    assert neighbors.nearest_neighbors(table(spark, x).limit(0), 3).count() == 0


def test_far_rings_are_not_sent(spark):
    """On clustered data a block of keys asks for few of the blocks there are."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4)) * 0.02 + rng.normal(size=(12, 4))[rng.integers(0, 12, 3000)] * 20
    rows = table(spark, x)
    placed, pivots, radius, rings = neighbors._placed(rows, 60, 60)
    asks = neighbors._open_rings(pivots, radius, rings, 5)
    import pyarrow as pa
    cells = {}
    for r in placed.collect():
        cells.setdefault((r["_c"], r["_ring"]), []).append((r["cell_id"], r["v"]))
    asked = 0
    for key, members in cells.items():
        ids, v = zip(*members)
        flat = [float(a) for row in v for a in row]
        batch = pa.RecordBatch.from_pydict({"_kb": ["b"], "key_id": [list(ids)], "key_v": [flat], "id": [list(ids)], "v": [flat]})
        asked += sum(b.num_rows for b in asks(iter([batch])))
    assert asked < 0.2 * len(cells) ** 2


def test_members_go_once_to_each_task(spark):
    asked = spark.createDataFrame([(k % 4, f"k{k}", c, 0, 0) for k in range(50) for c in range(3)], "_kg int, _kb string, _c int, _ring int, _ms int")
    members = spark.createDataFrame([(c, 0, 0, [c], [0.5]) for c in range(3)], "_c int, _ring int, _ms int, id array<bigint>, v array<double>")
    sent = neighbors._sent(asked, members).collect()
    assert len(sent) == 12 and sorted(k for r in sent for k in r["_asks"]) == sorted(f"k{k}" for k in range(50) for _ in range(3))
