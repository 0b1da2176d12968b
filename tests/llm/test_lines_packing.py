"""Line dedup, packing, the pipeline and the registered queries."""
import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from netloom.llm import linededup, packing
from netloom.llm.oracle import ORACLE
from netloom.llm.queries import QUERIES


def test_lines_equal_brute_force(make_docs):
    rows = [(k, "\n".join([f"own line {k}", "Menu | Home ", "", "shared by few" if k < 9 else "other", "Menu | Home", "\tcookies\r"]), None, f"s{k}") for k in range(30)]
    rows += [(100, None, None, "a"), (101, "", None, "a"), (102, "\n\n", None, None), (103, "Menu | Home", None, None), (None, "cookies\nx", None, "q"), (5, "Menu | Home\ny", None, "z")]
    docs = make_docs(rows, ["__pos", "sites", "first"])
    got = linededup.drop_boilerplate(docs)
    assert got.columns == docs.columns
    sites, first = defaultdict(set), {}
    for i, t, _, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if k := line.strip(" \t\r"):
                sites[k].add(s)
                first.setdefault(k, (i, p))
    for row in got.collect():
        options = [t for i, t, _, s in rows if i == row["doc_id"] and s == row["source"]]
        assert any((None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not (k := x.strip(" \t\r")) or len(sites[k] - {None}) < 10 or first[k] == (row["doc_id"], p))) == row["text"]
                   for t in options)
        assert row["n_chars"] == (None if row["text"] is None else len(row["text"]))
    assert linededup.line_report(make_docs([])).count() == 0


def test_estimates_far_from_the_threshold_and_exact_near_it(make_docs):
    rows = [(k * 100 + j, f"line {n}", None, f"s{j}") for k, n in enumerate((8, 9, 10, 11, 12, 40)) for j in range(n)]
    got = Counter(r["n_removed"] for r in linededup.line_report(make_docs(rows)).collect())
    assert got[1] == sum(n - 1 for n in (10, 11, 12, 40))


def test_long_text_of_common_lines(make_docs):
    rows = [(k, "\n".join(f"l{j}" for j in range(3000)), None, f"s{k}") for k in range(12)]
    got = sorted((r["doc_id"], r["n_removed"], r["n_chars"]) for r in linededup.line_report(make_docs(rows)).collect())
    assert got[0][1] == 0 and all(r[1:] == (3000, 0) for r in got[1:])


def test_sql_counterparts(spark, tiny):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, tiny).toPandas()
        want = db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist())), name


def least_cost(lengths, how):
    """Cheapest packing by trying every partition."""
    best = [float("inf")]

    def go(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(how.cost(min(c for c in how.capacities if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= max(how.capacities):
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_least_cost():
    how = packing.Pack(capacities=(4, 8, 16), knee=16)
    rng = np.random.default_rng(5)
    made = best = 0.0
    for _ in range(60):
        lengths = sorted(rng.integers(1, 17, 6).tolist(), reverse=True)
        out = packing.pack_shard(pa.table({"doc_id": range(6), "piece": [0] * 6, "length": lengths}), how).to_pandas()
        made += out.groupby("bin").capacity.first().map(how.cost).sum()
        best += least_cost(lengths, how)
    assert best <= made <= 1.1 * best


def check_packing(rows, lengths, how):
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == lengths
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["bin_id"], r["offset"])), key=lambda r: r["bin_id"]):
        own, at = list(own), 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert own[0]["capacity"] == min(c for c in how.capacities if c >= at)


def test_packing_places_everything(make_docs):
    how = packing.Pack(capacities=(8, 16, 32), shard_pieces=20)
    rows = [(k, "w " * (k % 37)) for k in range(90)] + [(200, None), (201, ""), (202, "x " * 500), (7, "a b"), (None, "a b c")]
    got = packing.packed(make_docs(rows, ["piece", "length", "shard"]), how).collect()
    lengths = Counter()
    for i, t in rows:
        lengths[i] += len((t or "").split()) + 1
    check_packing(got, lengths, how)
    assert packing.packed(make_docs([])).count() == 0


def test_packing_keeps_ids_beside_a_null(make_docs):
    ids = [2**53 + 1, 2**53 + 3, None, 2**62 + 1, -(2**60) - 1]
    got = packing.packed(make_docs([(i, "a b") for i in ids])).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(ids) and {r["length"] for r in got} == {3}


def test_lines_leave_columns_of_any_name(make_docs):
    names = ["__id", "__text_hash", "__kept", "__gone", "__row", "__pos", "a.b", "c`d"]
    docs = make_docs([(k, "shared line here\nown %d" % k, "en", "site%d" % k) for k in range(20)], names)
    got = linededup.drop_boilerplate(docs)
    assert got.columns == docs.columns
    rows = sorted(got.collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows] == ["shared line here\nown 0", *("own %d" % k for k in range(1, 20))]
    assert all(r[n] == "clash" for r in rows for n in names)


def test_pipeline_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, tiny).cache()
        assert left.columns == docs.columns and 0.8 * before.count() <= left.count() <= before.count()
    got = corpus_pipeline.run(spark, tiny).collect()
    lengths = Counter({r["doc_id"]: len((r["text"] or "").encode().split()) + 1 for r in left.collect()})
    check_packing(got, lengths, packing.Pack())


def test_pipeline_of_odd_rows(spark, make_docs, tmp_path):
    docs = make_docs([(1, None), (1, None), (None, "the and of to in"), (3, ""), (4, "x " * 20_000), (5, "12345")], ["key", "score"])
    for _, stage in corpus_pipeline.STAGES:
        docs.sparkSession.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        docs = stage(spark, docs, str(tmp_path))
        docs.count()
