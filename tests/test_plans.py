"""The three entry points on small files."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import PreprocessConfig, RunConfig, build_modules, build_scores, run_directory
from netloom.plans import run
from netloom.sources import files


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as handle:
        csv.writer(handle).writerows([header, *rows])


@pytest.fixture(scope="module")
def counts_csv(tmp_path_factory):
    rng = np.random.default_rng(2)
    level = rng.gamma(2.0, 20.0, size=(60, 2))
    x = np.column_stack([rng.poisson(level[:, g % 2]) for g in range(10)])
    path = tmp_path_factory.mktemp("input") / "counts.csv"
    write(path, ["barcode", *[f"g{i}" for i in range(10)]], [[f"c{i:02d}", *row] for i, row in enumerate(x)])
    return path


def test_preprocess_run_score(spark, counts_csv, tmp_path):
    out = tmp_path / "modules"
    manifest = build_modules(spark, PreprocessConfig("scrna", input_path=str(counts_csv), module_min_size=2, module_max_size=6, soft_power=1,
                                                     cut_height=0.9), str(out))
    assert manifest["normalization_mode"] == "counts_to_log1p" and manifest["modules"]["module_count"] >= 1
    done = run_directory(spark, str(out), str(tmp_path / "results"), RunConfig(significance_level=0.05))
    assert all(m["cell_count"] == 60 for m in done.values())
    again = run_directory(spark, str(out), str(tmp_path / "results"), RunConfig(significance_level=0.2))
    assert {m["significance_level"] for m in again.values()} == {0.05}
    wide = build_scores(spark, str(out), str(tmp_path / "results"), str(tmp_path / "scores.csv"), beta_mode="rank_blend")
    assert wide.count() == 60 and len(wide.columns) == 1 + sum(m["node_count"] for m in done.values())


def test_priors_change_networks(spark, tmp_path):
    rng = np.random.default_rng(4)
    a = rng.gamma(2.0, 1.0, size=80)
    x = np.column_stack([a, a + 0.1 * rng.normal(size=80), a + 0.1 * rng.normal(size=80), rng.gamma(2.0, 1.0, size=80)])
    write(tmp_path / "module_M001_expression.csv", ["barcode", "A", "B", "C", "D"], [[f"c{i}", *row] for i, row in enumerate(x)])
    write(tmp_path / "module_M001_expression_allowed_pairs.csv", ["gene_left", "gene_right"], [["A", "B"]])
    write(tmp_path / "module_M001_expression_tf_target_prior.csv", ["tf_module_column", "gene_module_column", "tf_target_score"], [["B", "A", 0.9]])
    config = RunConfig(use_pair_prior=True, tf_prior_mode="motif_prior")
    run_directory(spark, str(tmp_path), str(tmp_path / "r"), config)
    rows = spark.read.parquet(str(tmp_path / "r" / "graphs.parquet" / "module=module_M001_expression")).collect()
    assert len(rows) == 80 and all(r.targets in ([], [0]) for r in rows) and any(r.targets for r in rows)
    facts = json.loads((tmp_path / "r" / "module_M001_expression" / "run_manifest.json").read_text())
    assert facts["oriented_edges"] == facts["candidate_edges"] > 0
    drawn = [(s, t) for r in rows for s in range(r.n_genes) for t in r.targets[r.node_ptr[s] : r.node_ptr[s + 1]]]
    assert facts["direct_edge_count"] == sum(e == (1, 0) for e in drawn) == sum(r.direct_edges for r in rows) > 0
    assert facts["supported_pairs"] == facts["listed_pairs"] == 1 and facts["fallback_count"] == sum(r.fallback for r in rows)


def test_joint_modality(spark, tmp_path):
    rng = np.random.default_rng(8)
    a = rng.gamma(2.0, 1.0, size=60)
    x = np.column_stack([a, a + 0.1 * rng.normal(size=60), rng.gamma(2.0, 1.0, size=60)])
    write(tmp_path / "module_M001_expression.csv", ["barcode", *"ABC"], [[f"c{i}", *row] for i, row in enumerate(x)])
    write(tmp_path / "gene_peak_links.csv", ["gene_module_column", "peak_name", "peak_gene_corr", "association_pass"],
          [["A", "p1", 0.5, "True"], ["A", "p2", -0.5, "True"], ["B", "p2", 0.4, "False"]])
    access = [("p1", f"c{i}", float(rng.poisson(3))) for i in range(59)]  # the last cell has no count, only a place in the list
    entries = spark.createDataFrame(access, "peak_name string, barcode string, count double")
    barcodes = spark.createDataFrame([(f"c{i}",) for i in range(60)], "barcode string")
    named = files.write_access(entries, entries, barcodes, str(tmp_path))
    files.write_json(spark, f"{tmp_path}/preprocess_manifest.json", named)
    plain = run_directory(spark, str(tmp_path), str(tmp_path / "plain"), RunConfig())
    joint = run_directory(spark, f"file://{tmp_path}", f"file://{tmp_path}/joint", RunConfig(joint_mode="joint_modality"))
    assert (tmp_path / "joint" / "module_M001_expression" / "run_manifest.json").exists()
    assert joint["module_M001_expression"]["cell_count"] == 60
    assert joint["module_M001_expression"]["edge_count"] != plain["module_M001_expression"]["edge_count"]


def test_joint_run_needs_listed_cells(spark, tmp_path):
    rng = np.random.default_rng(8)
    write(tmp_path / "module_M001_expression.csv", ["barcode", "A", "B"], [[f"c{i}", *rng.gamma(2.0, 1.0, size=2)] for i in range(20)])
    write(tmp_path / "gene_peak_links.csv", ["gene_module_column", "peak_name", "peak_gene_corr", "association_pass"], [["A", "p1", 0.5, True], ["B", "p9", 0.5, True]])
    entries = spark.createDataFrame([("p1", "c0", 0.0)], "peak_name string, barcode string, count double")
    few = spark.createDataFrame([(f"c{i}",) for i in range(18)], "barcode string")
    files.write_json(spark, f"{tmp_path}/preprocess_manifest.json", files.write_access(entries, entries, few, str(tmp_path)))
    config = RunConfig(joint_mode="joint_modality")
    with pytest.raises(ValueError, match="2 cells .* c18, c19"):
        run_directory(spark, str(tmp_path), str(tmp_path / "r"), config)
    every = spark.createDataFrame([(f"c{i}",) for i in range(20)], "barcode string")
    files.write_json(spark, f"{tmp_path}/preprocess_manifest.json", files.write_access(entries, entries, every, f"file://{tmp_path}"))
    expr, genes, cells = files.read_modules(spark, files.module_files(spark, f"file://{tmp_path}"))
    profiles, profiled = run.joint_profiles(spark, f"file://{tmp_path}", genes, cells, config)
    assert profiles.count() == 0 and [r["gene"] for r in profiled.collect()] == [0]  # no positive count: a profile of zeros; p9 is unknown


def test_factors(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.gamma(2.0, 1.0, size=(40, 5))
    write(tmp_path / "module_M001_expression.csv", ["barcode", *"ABCDE"], [[f"c{i}", *row] for i, row in enumerate(x)])
    done = run_directory(spark, str(tmp_path), str(tmp_path / "r"), RunConfig(nmf_mode="force", nmf_components=3))
    assert done["module_M001_expression"]["node_names"] == ["factor_000", "factor_001", "factor_002"]
    wide = build_scores(spark, str(tmp_path), str(tmp_path / "r"))
    assert wide.columns == ["barcode", "factor_000", "factor_001", "factor_002"] and wide.count() == 40


def test_annotation_motifs_and_sequences(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text('#x\nchr1\ts\tgene\t100\t200\t.\t-\t.\tgene_id "E1.2"; gene_name "abc";\nchr1\ts\texon\t1\t2\t.\t+\t.\tgene_id "E9";\n')
    starts, aliases = files.read_annotation(spark, str(gtf))
    assert {(r.key, r.pos) for r in starts.collect()} == {("abc", 200), ("E1.2", 200), ("E1", 200)}
    assert {(r.alias, r.symbol) for r in aliases.collect()} == {("ABC", "abc"), ("E1", "abc")}
    pfm = tmp_path / "m.txt"
    pfm.write_text(">MA1\tAbc::Def(var.2)\nA [ 4 0 ]\nC [ 0 4 ]\nG [ 0 0 ]\nT [ 0 0 ]\n")
    motif = files.read_motifs(spark, str(pfm)).first()
    assert motif.tokens == ["ABC", "DEF"] and motif.counts == [[4, 0, 0, 0], [0, 4, 0, 0]]
    fasta = tmp_path / "g.fa"
    fasta.write_text(">chr1 x\nacgta\nccccc\ngg\n>2\nTTTTT\nAAAAA\n")
    peaks = spark.createDataFrame([("p", "1", 4, 11), ("q", "chr2", 1, 6), ("r", "9", 1, 5)], "peak_name string, chrom string, start bigint, end bigint")
    found = {r.peak_name: r.sequence for r in files.read_sequences(spark, str(fasta), peaks, 4).collect()}
    assert found == {"p": "TACCCCCG", "q": "TTTTTA"}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%x\n2 3 3\n1 1 5\n2 1 7\n1 3 9\n")
    (tmp_path / "features.tsv").write_text("E1\tA\tGene Expression\tchr1\t5\t9\nE2\tB\tPeaks\tchr2\t6\t8\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\nz\n")
    counts, listed, barcodes = files.read_coordinates(spark, str(tmp_path))
    assert {tuple(r) for r in counts.collect()} == {(1, 1, 5.0), (1, 2, 7.0), (3, 1, 9.0)}
    assert {(r.feature_id, r.name, r.interval) for r in listed.collect()} == {(1, "A", "chr1:5-9"), (2, "B", "chr2:6-8")}
    assert {tuple(r) for r in barcodes.collect()} == {(1, "x"), (2, "y"), (3, "z")}


def test_multiome(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 50
    drive = rng.gamma(2.0, 10.0, size=n)
    genes = [rng.poisson(drive if i < 4 else 20, size=n) for i in range(6)]
    peaks = [rng.poisson(drive / 4, size=n) for _ in range(3)]
    rows = [(c, f, float(x[c])) for f, x in enumerate([*genes, *peaks], start=1) for c in range(n) if x[c]]
    spark.createDataFrame(rows, "cell_id bigint, feature_id bigint, count double").write.parquet(str(tmp_path / "counts.parquet"))
    table = [(i + 1, f"G{i}", f"E{i}.1", "Gene Expression", f"chr1:{1000 + 100 * i}-{1050 + 100 * i}", i) for i in range(6)]
    table += [(7 + i, f"chr1:{900 + 300 * i}-{950 + 300 * i}", f"p{i}", "Peaks", f"chr1:{900 + 300 * i}-{950 + 300 * i}", 6 + i) for i in range(3)]
    spark.createDataFrame(table, "feature_id bigint, name string, gene_id string, feature_type string, interval string, ordinal bigint").write.parquet(
        str(tmp_path / "features.parquet"))
    spark.createDataFrame([(i, f"b{i}") for i in range(n)], "cell_id bigint, barcode string").write.parquet(str(tmp_path / "barcodes.parquet"))
    (tmp_path / "m.txt").write_text(">MA1\tG0\nA [ 9 0 0 ]\nC [ 0 9 0 ]\nG [ 0 0 9 ]\nT [ 0 0 0 ]\n")
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(["TTACGTTTTT"] * 200) + "\n")
    (tmp_path / "a.gtf").write_text('chr1\ts\tgene\t1000\t1100\t.\t+\t.\tgene_id "E0.1"; gene_name "G0";\n')
    config = PreprocessConfig("paired_multiome", input_path=str(tmp_path), gtf=str(tmp_path / "a.gtf"), module_min_size=2, module_max_size=6,
                              soft_power=1, cut_height=0.99, min_gene_cells=1, min_peak_cells=1, enable_motif_prior=True,
                              motif_file=str(tmp_path / "m.txt"), genome_fasta=str(tmp_path / "g.fa"), peak_gene_corr_threshold=0.0)
    manifest = build_modules(spark, config, str(tmp_path / "out"))
    assert manifest["selected_shape"] == [n, 6] and manifest["peak_gene_link_count"] > 0
    assert manifest["anchor_source_counts"] == {"gtf_tss": 1, "h5_interval_start": 5}
    assert manifest["motif_triplet_count"] > 0
    done = run_directory(spark, str(tmp_path / "out"), str(tmp_path / "joint"), RunConfig(joint_mode="joint_modality", max_cond_vars=1))
    assert done and all(m["cell_count"] == n for m in done.values())  # the bundle is all that a joint run needs


def test_config_checks():
    with pytest.raises(ValueError):
        RunConfig(pc_variant="other").validate()
    with pytest.raises(ValueError):
        RunConfig(analysis_mode="regulatory", nmf_mode="force").validate()
    with pytest.raises(ValueError):
        PreprocessConfig("scrna").validate()


def test_cells_are_numbered_by_line(spark, tmp_path):
    first, second = tmp_path / "module_a_expression.csv", tmp_path / "module_b_expression.csv"
    names = [f"c{(7 * i) % 50:02d}" for i in range(50)]
    first.write_text("barcode,g1\n" + "".join(f"{n},1\n" for n in names))
    second.write_text("barcode,g2\n" + "".join(f"{n},1\n" for n in [*reversed(names), "late"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = {r.barcode: r.cell_id for r in files.number_cells(spark, [str(first), str(second)]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: i for i, n in enumerate([*names, "late"])}


def test_wide_headers_are_read(spark, tmp_path):
    path = tmp_path / "module_a_expression.csv"
    names = [f"g{i}" for i in range(21_000)]
    path.write_text(",".join(["barcode", *names]) + "\nc1" + ",1" * len(names) + "\n")
    _, found = files.wide_csv(spark, str(path))
    assert found == names


def test_allow_lists_restrict_their_own_module(spark):
    rng = np.random.default_rng(3)
    base = rng.random((120, 4))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.01 * base[:, 1], base[:, 2], base[:, 2] + 0.01 * base[:, 3]])
    rows = [(m, c, g, float(x[c, g])) for m in ("a", "b") for c in range(120) for g in range(4)]
    expr = spark.createDataFrame(rows, "module string, cell_id bigint, gene int, value double")
    genes = spark.createDataFrame([(m, g, f"g{g}") for m in ("a", "b") for g in range(4)], "module string, gene int, name string")
    pairs = spark.createDataFrame([("a", "g0", "g1", 1.0)], "module string, a string, b string, w double")
    config = RunConfig(use_pair_prior=True)
    done = run.run_modules(expr, genes, config, pairs, listed_modules=["a"]).graphs.groupBy("module").agg(F.sum(F.size("targets")).alias("n")).collect()
    edges = {r.module: r.n for r in done}
    every = {r.module: r.n for r in run.run_modules(expr, genes, config, pairs).graphs.groupBy("module").agg(F.sum(F.size("targets")).alias("n")).collect()}
    assert edges["b"] > 0 and every["b"] == 0 and edges["a"] == every["a"] > 0
