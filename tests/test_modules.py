"""Modules by rounds over tables against a plain sequential form of the same rules."""

import numpy as np
from pyspark.sql import functions as F

from netloom.operators import linkage, modules


def plain_merges(distance, cut=np.inf):
    """Merges (kept, absorbed, height), each the nearest pair of all clusters, the lowest pair on ties."""
    clusters, out = {i: [i] for i in range(len(distance))}, []
    while len(clusters) > 1:
        height, a, b = min((distance[np.ix_(clusters[a], clusters[b])].mean().round(9), a, b) for a in clusters for b in clusters if a < b)
        if height > cut:
            break
        out.append((a, b, height))
        clusters[a] += clusters.pop(b)
    return out


def plain_clusters(members, merges):
    owner = {m: m for m in range(len(members))}
    for a, b, _ in merges:
        owner = {m: a if o == b else o for m, o in owner.items()}
    return [[members[m] for m in owner if owner[m] == o] for o in sorted(set(owner.values()))]


def plain_distance(cov, members, power):
    norm = np.sqrt(np.diag(cov))
    a = np.abs(cov / np.outer(norm, norm))[np.ix_(members, members)] ** power
    np.fill_diagonal(a, 0)
    degree = a.sum(0)
    return 1 - (a @ a + a) / (np.minimum.outer(degree, degree) + 1 - a)


def plain_modules(cov, power, cut, least, largest):
    def cut_large(members, cut):
        if len(members) <= largest:
            return [members]
        d = plain_distance(cov, members, power)
        parts = plain_clusters(members, plain_merges(d, cut))
        if len(parts) == 1:
            merges = plain_merges(d)
            limit = merges[len(members) - -(-len(members) // largest) - 1][2]
            parts = plain_clusters(members, [m for m in merges if m[2] <= limit])
        if len(parts) == 1:
            order = sorted(members, key=lambda g: (-cov[g, g], g))
            return [sorted(order[k:k + largest]) for k in range(0, len(order), largest)]
        return [m for p in parts for m in cut_large(p, max(0.35, cut - 0.05))]

    def sized(raw):
        parts = [m for r in raw for m in cut_large(r, cut)]
        kept, waiting = [m for m in parts if len(m) >= least], sorted((m for m in parts if len(m) < least), key=lambda m: (-len(m), min(m)))
        while waiting:
            own = waiting.pop(0)
            while len(own) < least and (fits := [m for m in waiting if len(m) + len(own) <= largest]):
                like = [cov[np.ix_(own, m)].mean() / np.sqrt(cov[np.ix_(own, own)].mean() * cov[np.ix_(m, m)].mean()) for m in fits]
                best = fits[int(np.argmax(like))]
                waiting.remove(best)
                own = own + best
            kept += [sorted(own)] if len(own) >= least else []
        return sorted((m for m in kept if least <= len(m) <= largest), key=lambda m: (-len(m), min(m)))

    genes = list(range(len(cov)))
    return sized(plain_clusters(genes, plain_merges(plain_distance(cov, genes, power), cut))) or sized([genes])


def pairs_of(spark, sets):
    rows = [(s, i, j, float(d[i, j])) for s, d in sets.items() for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, "set string, a int, b int, distance double")


def covariance_of(spark, sets):
    rows = [(s, i, j, float(c[i, j])) for s, c in sets.items() for i in range(len(c)) for j in range(i, len(c))]
    return spark.createDataFrame(rows, "module string, i int, j int, cov double")


def found_in(table):
    out = {}
    for r in table.orderBy("dataset", "module_no", "order_in_module").collect():
        out.setdefault(r.dataset, {}).setdefault(r.module_no, []).append(r.gene)
    return {d: list(m.values()) for d, m in out.items()}


def test_rounds_merge_as_the_sequential_rule_does(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(14, 2))
    spread = np.abs(points[:, None] - points[None]).sum(-1)
    grid = np.abs(np.arange(9)[:, None] - np.arange(9)[None]).astype(float)  # many equal distances
    sets = {"spread": spread, "grid": grid, "same": np.ones((5, 5)) - np.eye(5)}
    for cut in (None, 1.5):
        got = linkage.linkage(pairs_of(spark, sets), cut).collect()
        for name, distance in sets.items():
            want = plain_merges(distance, np.inf if cut is None else cut)
            mine = sorted((r.parent, r.child, round(r.height, 6)) for r in got if r.set == name)
            assert mine == sorted((a, b, round(float(h), 6)) for a, b, h in want)


def test_roots_of_long_paths(spark):
    merges = spark.createDataFrame([("s", k + 1, k, 0.1) for k in range(9)], "set string, child int, parent int, height double")
    members = spark.createDataFrame([("s", k) for k in range(12)] + [("t", 5)], "set string, gene int")
    got = {(r.set, r.gene): r.root for r in linkage.roots(merges, members, "gene").collect()}
    assert got == {**{("s", k): 0 if k < 10 else k for k in range(12)}, ("t", 5): 5}


def test_modules_policy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 200, 1))
    x = np.hstack([a + 0.2 * rng.normal(size=(200, 6)), b + 0.2 * rng.normal(size=(200, 5))])
    y = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 18)) + rng.normal(size=(60, 18))
    cov = {n: (m - m.mean(0)).T @ (m - m.mean(0)) for n, m in (("two", x), ("mixed", y))}
    got = found_in(modules.gene_modules(covariance_of(spark, cov), 6, 0.7, 3, 6))
    assert got["two"] == [list(range(6)), list(range(6, 11))]
    assert got == {n: plain_modules(c, 6, 0.7, 3, 6) for n, c in cov.items()}


def test_modules_cut_by_force_and_none(spark):
    same = np.full((7, 7), 2.0) + np.diag(np.arange(7) * 1e-12)  # equal heights: pieces by variance
    cov = covariance_of(spark, {"same": same})
    assert found_in(modules.gene_modules(cov, 6, 0.7, 2, 3)) == {"same": [[1, 2, 3], [4, 5, 6]]}
    assert modules.gene_modules(cov.limit(0)).isEmpty()
    one = covariance_of(spark, {"one": np.ones((1, 1))})
    assert found_in(modules.gene_modules(one, 6, 0.7, 1, 3)) == {"one": [[0]]}
    assert modules.gene_modules(one, 6, 0.7, 2, 3).isEmpty()


def test_small_clusters_fetch_rows_in_batches(spark, monkeypatch):
    monkeypatch.setattr(modules, "FETCHED", 2)
    monkeypatch.setattr(modules, "HELD", 3)
    x = np.random.default_rng(5).normal(size=(40, 13))
    cov = (x - x.mean(0)).T @ (x - x.mean(0))
    assert found_in(modules.gene_modules(covariance_of(spark, {"x": cov}), 6, 0.2, 3, 5)) == {"x": plain_modules(cov, 6, 0.2, 3, 5)}
