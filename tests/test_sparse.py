"""Implicit zeros against the same data with every zero written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import counts, neighborhoods, ranks, sparse


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(70, 6)), 1) * (rng.random((70, 6)) < 0.4)
    x[:, 4] = 0.0
    x[:, 5] = np.abs(x[:, 5]) + 1.0  # no zero at all
    return x


def frames(spark, x):
    rows = [("m", c, g, float(x[c, g])) for c in range(x.shape[0]) for g in range(x.shape[1])]
    full = spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double")
    listed = full.select("module", "gene").distinct()
    return full, full.filter("value <> 0 or cell_id = 3"), listed


def test_ranks_and_quantiles(spark, dense):
    full, held, listed = frames(spark, dense)
    key = ["module", "gene"]
    want = {(r["gene"], r["cell_id"]): r["avg_rank"] for r in ranks.average_rank(full, key).collect()}
    rows, facts = sparse.centred_ranks(held, listed, key, 70)
    zero = {r["gene"]: r for r in facts.collect()}
    got = {(r["gene"], r["cell_id"]): r["rank"] + zero[r["gene"]]["zero_rank"] for r in rows.collect()}
    assert len(got) == int((dense != 0).sum()) and all(want[k] == v for k, v in got.items())
    assert all(want[g, c] == zero[g]["zero_rank"] for g in range(6) for c in range(70) if dense[c, g] == 0)
    assert abs(zero[1]["spread"] - np.var([want[1, c] for c in range(70)]) * 70) < 1e-6
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        found = {r["gene"]: r["quantile"] for r in sparse.zero_filled_quantile(held, listed, key, 70, q).collect()}
        assert all(abs(found[g] - np.quantile(dense[:, g], q)) < 1e-12 for g in range(6))


def test_rank_correlations(spark, dense):
    full, held, listed = frames(spark, dense)
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "left_id int, right_id int")
    side = lambda name: sparse.centred_ranks(held.select(F.col("gene").alias(name), "cell_id", "value"), listed.select(F.col("gene").alias(name)), [name], 70)
    got = {(r["left_id"], r["right_id"]): r["corr"] for r in sparse.sparse_rank_correlations(pairs, side("left_id"), side("right_id"), 70).collect()}
    rank = np.zeros_like(dense)
    for r in ranks.average_rank(full, ["module", "gene"]).collect():
        rank[r["cell_id"], r["gene"]] = r["avg_rank"]
    for a in range(6):
        for b in range(6):
            want = 0.0 if 4 in (a, b) else np.corrcoef(rank[:, a], rank[:, b])[0, 1]
            assert abs(got[a, b] - want) < 1e-9


def test_joint_vectors(spark, dense):
    full, held, listed = frames(spark, dense)
    first = full.withColumn("value", F.col("value") + F.col("gene"))
    for fraction, floor in ((0.1, 0.0), (0.3, 0.5)):
        floored = full.withColumn("value", F.when(F.col("value") <= floor, 0.0).otherwise(F.col("value")))
        both = neighborhoods.cell_neighborhoods(first, fraction).unionByName(
            neighborhoods.cell_neighborhoods(floored, fraction, floor).withColumn("gene", F.col("gene") + 100))
        want = {r["cell_id"]: r for r in counts.cell_vectors(both).collect()}
        got = counts.joint_vectors(first, floored.filter("value <> 0"), fraction, floor, listed).collect()
        assert len(got) == 70 and all(want[r["cell_id"]] == r for r in got)
