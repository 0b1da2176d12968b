import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from netloom.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over Python integers."""
    def fine(e):
        return e is not None and all(v is not None and math.isfinite(v) and math.isfinite(256 * v) for v in e)
    rows = [(i, [float(v) for v in e], lab) for i, e, lab in rows if fine(e)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    length = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == length]
    width = max(1, -(-length // parts))
    def cut(e):
        x = [math.floor(256.0 * v) for v in e] + [0] * (parts * width - length)
        return [x[k * width : (k + 1) * width] for k in range(parts)]
    xs = [cut(e) for _, e, _ in rows]
    books = [[x[k] for x in xs[:entries]] for k in range(parts)]
    def near(p, book):
        d = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for k in range(parts):
            groups = defaultdict(list)
            for x in xs:
                groups[near(x[k], books[k])[0]].append(x[k])
            for e, ps in groups.items():
                books[k][e] = [sum(c) // len(ps) for c in zip(*ps)]
    own = [str(v) for k in range(parts) for e in books[k] for v in e[: max(0, min(width, length - k * width))]]
    sha = hashlib.sha256(",".join(own).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for (i, _, lab), x in zip(rows, xs):
        got = [near(x[k], books[k]) for k in range(parts)]
        error = min(sum(d for _, d in got), 2**63 - 1)
        total[lab] += error
        out.append((i, "".join(f"{e:02x}" for e, _ in got), error, lab))
    return sorted(((i, c, e, min(total[lab], 2**63 - 1), sha) for i, c, e, lab in out), key=str)


def got(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema).withColumn("code", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    out = vectorcodes.code_report(df, **how)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def table(n, length, seed=1, scale=1.0):
    rnd = random.Random(seed)
    return [(rnd.randrange(10 * n), [rnd.gauss(0, scale) for _ in range(length)], rnd.choice([None, 0, 1])) for _ in range(n)]


def test_equals_plain_loops(spark):
    rows = table(300, 32)
    rows += rows[:40]  # repeated rows
    rows += [(5, None, 1), (6, [None] * 32, 1), (7, [math.nan] * 32, 1), (8, [math.inf] * 32, 2), (9, [1.0] * 31, 2), (None, [0.5] * 32, None)]
    rows += [(-1, [0.0] * 32, 3)] * 50  # one hot vector, and ties between equal first entries
    assert got(spark, rows) == brute(rows)
    for rounds in (0, 1, 3):
        assert got(spark, rows, parts=4, entries=7, rounds=rounds) == brute(rows, 4, 7, rounds)


def test_small_and_odd_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    for length in (0, 1, 5, 17):
        rows = table(40, length, seed=length)
        assert got(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = table(60, 16, seed=4) + table(60, 16, seed=5, scale=1e5) + [(1000 + k, [3.0e38 * (k % 3 - 1)] * 16, 9) for k in range(9)]
    assert got(spark, rows) == brute(rows)
    large = table(80, 16, seed=6, scale=4e4)
    assert got(spark, large) == brute(large)


def test_given_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    assert sorted((tuple(r) for r in vectorcodes.code_report(df).collect()), key=str) == brute(rows)


def test_only_changed_members_leave(spark, tiny):
    df = vectorcodes.kept(spark.read.parquet(f"{tiny}/embeddings.parquet")).select("x")
    book = vectorcodes.first_codebook(vectorcodes.kept(spark.read.parquet(f"{tiny}/embeddings.parquet")), 16, 64)
    def send(book):
        return spark.sparkContext.broadcast(cloudpickle.dumps(book))

    members = df.mapInArrow(vectorcodes._dealt(64, 16, send(book), 8), vectorcodes._BLOCK)
    same = members.mapInArrow(vectorcodes._moved(send(book), 8), vectorcodes._BLOCK)
    assert same.where("moved").count() == 0 and same.agg(F.sum("n")).first()[0] == 16 * df.count()
    new = vectorcodes._updated(members, book)
    seen = members.mapInArrow(vectorcodes._moved(send(new), 8), vectorcodes._BLOCK)
    assert 0 < seen.where("moved").agg(F.sum("n")).first()[0] < 8 * df.count()
    assert seen.agg(F.sum("n")).first()[0] == 16 * df.count()


@pytest.mark.parametrize("values", [[1, 2, 3], [2**40, -(2**40)], [2**100, 5]])
def test_distances_are_exact(values):
    import numpy as np
    parts = np.array([[float(v)] * 3 for v in values])
    assert [[int(d) for d in row] for row in vectorcodes.distances(parts, parts)] == [[3 * (a - b) ** 2 for b in values] for a in values]
