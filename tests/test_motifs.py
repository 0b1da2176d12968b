"""The block scan against window-by-window scores."""

import math
import random

import numpy as np
import pytest

from netloom.operators import motifs


def plain(text, m, cutoff):
    span = m["max_score"] - m["min_score"]
    least = m["max_score"] if span <= 1e-8 else m["min_score"] + cutoff * span
    best, width = None, len(m["pssm"])
    for strand, rows in (("-", [r[::-1] for r in m["pssm"][::-1]]), ("+", m["pssm"])):
        top = None
        for p in range(len(text) - width + 1):
            window = text[p : p + width].upper()
            if set(window) <= set("ACGT"):
                score = rows[0]["ACGT".index(window[0])]
                for k in range(1, width):
                    score += rows[k]["ACGT".index(window[k])]
                if score >= least and (top is None or score > top[0]):
                    top = score, p
        if top:
            rel = 1.0 if span <= 1e-8 else (top[0] - m["min_score"]) / span
            if best is None or rel > best[0]:
                best = rel, top[0], len(text) - top[1] if strand == "-" else top[1], strand == "-"
    return best


@pytest.mark.parametrize("cutoff", [0.2, 0.85, 1.0])
def test_blocks_equal_single_windows(cutoff, monkeypatch):
    monkeypatch.setattr(motifs, "CODES", 50)
    monkeypatch.setattr(motifs, "MOTIFS_PER_BLOCK", 3)
    rnd = random.Random(5)
    listed = []
    for i in range(12):
        width = rnd.choice([1, 3, 4, 6, 9])
        rows = [[0.25] * 4 for _ in range(width)] if i == 3 else [[math.log2(rnd.random() + 0.05) for _ in range(4)] for _ in range(width)]
        low = high = 0.0
        for r in rows:
            low, high = low + min(r), high + max(r)
        listed.append({"pssm": rows, "min_score": low, "max_score": high})
    listed.append({"pssm": [], "min_score": 0.0, "max_score": 0.0})
    texts = ["".join(rnd.choice("ACGTacgtN") for _ in range(rnd.choice([0, 2, 8, 30, 170]))) for _ in range(25)] + ["", "NNNN", "ACGT", "é"]
    got = {(t, m): rest for t, m, *rest in motifs.best_hits(texts, motifs._blocks(listed, cutoff), listed)}
    want = {(t, m): list(best) for t, text in enumerate(texts) for m, own in enumerate(listed) if own["pssm"] and (best := plain(text, own, cutoff))}
    assert got == want and want


def test_passes_are_united(spark, monkeypatch):
    monkeypatch.setattr(motifs, "MOTIFS_PER_PASS", 2)
    rows = [(f"T{k % 3}", k, f"m{k}", f"n{k}", [[1.0, -1.0, -2.0, 0.5 * k]] * 2, -4.0, 2.0) for k in range(5)]
    catalogue = spark.createDataFrame(rows, "tf_symbol string, ordinal bigint, motif_id string, motif_name string, pssm array<array<double>>, min_score double, max_score double")
    seqs = spark.createDataFrame([("a", "CCAACC"), ("b", None), ("c", "GG")], "peak_name string, sequence string")
    got = sorted(motifs.scan_sequences(seqs, catalogue).collect())
    monkeypatch.setattr(motifs, "MOTIFS_PER_PASS", 100)
    assert got == sorted(motifs.scan_sequences(seqs, catalogue).collect()) and {r["tf_symbol"] for r in got} == {"T0", "T1", "T2"}
    assert {r["peak_name"] for r in got} == {"a", "c"} and np.isclose(max(r["rel_score"] for r in got), 1.0)
