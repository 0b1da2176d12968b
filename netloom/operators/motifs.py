"""Motif scoring of sequences and the regulator-peak-gene triplets built on the hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_token
from ..session import cut_lineage
from .normalize import min_max

# Pseudocount, default relative cutoff, letters, smallest usable score span.
PSEUDOCOUNT = 0.5
RELATIVE_CUTOFF = 0.85
LETTERS = "ACGT"
TINY = 1e-8
MOTIFS_PER_PASS, MOTIFS_PER_BLOCK = 5000, 32
SEGMENT, CODES = 4, 1 << 16


def log_odds(motifs: DataFrame) -> DataFrame:
    """Replace ``counts`` (positions x ACGT) by ``pssm`` log2 odds against uniform letters, with its score range."""
    def row(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c) + 4 * PSEUDOCOUNT
        return F.transform(counts, lambda c: F.log2((c + PSEUDOCOUNT) / total / 0.25))

    scored = motifs.withColumn("pssm", F.transform("counts", row)).drop("counts")
    ends = lambda pick: F.aggregate("pssm", F.lit(0.0), lambda s, r: s + pick(r))
    return scored.withColumn("min_score", ends(F.array_min)).withColumn("max_score", ends(F.array_max))


def motifs_by_symbol(motifs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row per (symbol, motif) with ``ordinal`` kept; optionally only the listed symbols."""
    rows = motifs.withColumn("tf_symbol", F.explode("tokens")).drop("tokens")
    return rows if symbols is None else rows.join(symbols.select("tf_symbol").distinct(), "tf_symbol", "left_semi")


def _encode(text: str) -> np.ndarray:
    table = np.full(256, 4, dtype=np.uint8)
    for code, letter in enumerate(LETTERS):
        table[ord(letter)] = table[ord(letter.lower())] = code
    return table[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]


class MotifBlock:
    """Motifs of one width on one strand, as tables over runs of ``SEGMENT`` letters.

    A window's score is the sum of one table entry per run.  After each run only windows that can still reach the motif's least
    score, with the best letters from there on, are looked at further; the scores of those that stay are added up letter by letter.
    """

    def __init__(self, matrices: np.ndarray, least: np.ndarray):
        self.matrices = np.concatenate([matrices, np.full((*matrices.shape[:2], 1), -np.inf)], axis=2)  # a fifth letter for all others
        self.least, self.width = least, matrices.shape[1]
        self.cuts = list(range(0, self.width, SEGMENT))
        self.tables = []
        for low in self.cuts:
            table = np.zeros((len(matrices), 1))
            for k in range(low, min(low + SEGMENT, self.width)):
                table = (table[:, :, None] + self.matrices[:, k, None, :]).reshape(len(matrices), -1)
            self.tables.append(table)
        tops = matrices.max(axis=2)
        self.rest = [tops[:, low + SEGMENT :].sum(axis=1) for low in self.cuts]
        self.slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(matrices), matrices, 0.0)).sum(axis=(1, 2)))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(motif, place, score) of the windows at or over their motif's least score."""
        places = len(codes) - self.width + 1
        if places <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        runs = []
        for low in self.cuts:
            run = np.zeros(places, np.int32)
            for k in range(low, min(low + SEGMENT, self.width)):
                run = run * 5 + codes[k : k + places]
            runs.append(run)
        enough = self.least - self.slack
        first = self.tables[0][:, runs[0]]
        motif, place = np.nonzero(first >= (enough - self.rest[0])[:, None])
        score = first[motif, place]
        for table, run, rest in zip(self.tables[1:], runs[1:], self.rest[1:]):
            score = score + table[motif, run[place]]
            stay = score >= enough[motif] - rest[motif]
            motif, place, score = motif[stay], place[stay], score[stay]
        exact = self.matrices[motif, 0, codes[place]]
        for k in range(1, self.width):
            exact = exact + self.matrices[motif, k, codes[place + k]]
        stay = exact >= self.least[motif]
        return motif[stay], place[stay], exact[stay]


def _blocks(listed: list[dict], cutoff: float) -> list[tuple[np.ndarray, MotifBlock, MotifBlock]]:
    """Places in the list, and their minus and plus strands, of motifs of equal width, ``MOTIFS_PER_BLOCK`` at most."""
    widths: dict[int, list[int]] = {}
    for i, m in enumerate(listed):
        if m["pssm"]:
            widths.setdefault(len(m["pssm"]), []).append(i)
    out = []
    for own in widths.values():
        for low in range(0, len(own), MOTIFS_PER_BLOCK):
            part = own[low : low + MOTIFS_PER_BLOCK]
            matrices = np.array([listed[i]["pssm"] for i in part], float)
            ends = np.array([(listed[i]["min_score"], listed[i]["max_score"]) for i in part])
            span = ends[:, 1] - ends[:, 0]
            least = np.where(span <= TINY, ends[:, 1], ends[:, 0] + cutoff * span)
            out.append((np.array(part), MotifBlock(matrices[:, ::-1, ::-1], least), MotifBlock(matrices, least)))
    return out


def best_hits(texts: list[str], blocks, listed: list[dict]):
    """(text, motif, rel, abs, position, minus) of the best window of each text and motif: minus strand first, then by place.

    Texts are scored end to end, a separator between them, ``CODES`` letters at a time and no text in two pieces.
    """
    codes = [_encode(t) for t in texts]
    at = 0
    while at < len(codes):
        stop, size = at, 0
        while stop < len(codes) and (stop == at or size + len(codes[stop]) < CODES):
            size += len(codes[stop]) + 1
            stop += 1
        joined = np.concatenate([x for c in codes[at:stop] for x in (c, np.array([4], np.uint8))])
        starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in codes[at:stop]])[:-1]))
        for part, *strands in blocks:
            found = []
            for plus, block in enumerate(strands):
                for low in range(0, len(joined), CODES):  # one text may be longer than a piece
                    motif, place, score = block.hits(joined[low : low + CODES + block.width - 1])
                    found.append((motif, place + low, score, np.full(len(motif), plus)))
            motif, place, score, plus = (np.concatenate(c) for c in zip(*found))
            text = np.searchsorted(starts, place, "right") - 1
            ends = np.array([(listed[i]["min_score"], listed[i]["max_score"]) for i in part])
            span = ends[:, 1] - ends[:, 0]
            rel = np.where(span[motif] <= TINY, 1.0, (score - ends[motif, 0]) / np.where(span[motif] <= TINY, 1.0, span[motif]))
            # The best score of a strand comes first; between strands the relative score decides and minus wins ties.
            order = np.lexsort((place, -score, plus, motif, text))
            key = np.stack([text[order], motif[order], plus[order]])
            head = np.ones(len(order), bool)
            head[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            order = order[head]
            order = order[np.lexsort((plus[order], -rel[order], motif[order], text[order]))]
            key = np.stack([text[order], motif[order]])
            head = np.ones(len(order), bool)
            head[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            for i in order[head].tolist():
                t = int(text[i])
                own = int(place[i] - starts[t])
                yield at + t, int(part[motif[i]]), float(rel[i]), float(score[i]), own if plus[i] else len(codes[at + t]) - own, not plus[i]
        at = stop


def _best_hit(codes: np.ndarray, motif: dict, cutoff: float) -> tuple | None:
    """(rel, abs, position, strand) of the best window of one encoded text, or None."""
    listed = [{**motif, "pssm": motif["matrix"].tolist()}]
    for _, _, rel, score, place, minus in best_hits(["".join("ACGTN"[c] for c in codes)], _blocks(listed, cutoff), listed):
        return rel, score, place, "-" if minus else "+"
    return None


def scan_sequences(sequences: DataFrame, motifs: DataFrame, cutoff: float = RELATIVE_CUTOFF) -> DataFrame:
    """Best hit per (peak_name, tf_symbol) over all its motifs and both strands.

    ``motifs`` (tf_symbol, ordinal, motif_id, motif_name, pssm, min_score, max_score) is a published catalogue, read and sent to
    the tasks ``MOTIFS_PER_PASS`` at a time; with more than one pass each one's hits are written before the next is read, so the
    driver never holds more than one. Sequences stay where they are.
    """
    columns = ["tf_symbol", "ordinal", "motif_id", "motif_name", "pssm", "min_score", "max_score"]
    out = (
        "peak_name string, tf_symbol string, ordinal bigint, motif_id string, motif_name string, "
        "rel_score double, abs_score double, position bigint, strand string"
    )
    rows = sequences.select(F.col("peak_name").cast("string").alias("peak_name"), "sequence")

    def scan(part: list[dict]):
        def run(batches):
            blocks = _blocks(part, cutoff)
            for batch in batches:
                names, texts = batch.column("peak_name").to_pylist(), [t or "" for t in batch.column("sequence").to_pylist()]
                held = [(names[t], part[m]["tf_symbol"], part[m]["ordinal"], part[m]["motif_id"], part[m]["motif_name"], rel, score, place, "-" if minus else "+")
                        for t, m, rel, score, place, minus in best_hits(texts, blocks, part)]
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(
                        ["peak_name", "tf_symbol", "ordinal", "motif_id", "motif_name", "rel_score", "abs_score", "position", "strand"], map(list, zip(*held)))))

        return rows.mapInArrow(run, out)

    hits, part = None, []
    for r in motifs.select(*columns).toLocalIterator():
        part.append(r.asDict())
        if len(part) == MOTIFS_PER_PASS:
            done = cut_lineage(scan(part))
            hits, part = done if hits is None else hits.unionByName(done), []
    if part or hits is None:
        hits = scan(part) if hits is None else hits.unionByName(scan(part))
    # The first of equal scores wins, in catalogue order.
    best = F.max_by(F.struct(*[c for c in hits.columns if c not in ("peak_name", "tf_symbol")]),
                    F.struct("rel_score", -F.col("ordinal")))
    return hits.groupBy("peak_name", "tf_symbol").agg(best.alias("_h")).select("peak_name", "tf_symbol", "_h.*").drop("ordinal")


def triplets(links: DataFrame, hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Regulator-peak-gene rows with positive score inside each module.

    ``links``: module, gene_module_column, gene_symbol, peak_name, peak_interval, peak_gene_corr, peak_median.
    ``genes``: module, module_column, gene_id, gene_symbol.
    """
    scored = min_max(links, ["module"], "peak_median", "peak_accessibility_score")
    scored = min_max(scored, ["module", "gene_module_column"], "peak_gene_corr", "peak_gene_corr_score")
    regulators = genes.select(
        "module", F.col("module_column").alias("tf_module_column"), F.col("gene_id").alias("tf_gene_id"),
        F.col("gene_symbol").alias("tf_name"), canonical_token(F.coalesce("gene_symbol", "module_column")).alias("tf_symbol"),
    )
    targets = genes.select("module", F.col("module_column").alias("gene_module_column"), F.col("gene_id").alias("gene_gene_id"))
    score = F.col("rel_score") * F.col("peak_accessibility_score") * F.col("peak_gene_corr_score")
    return (
        scored.join(hits, "peak_name")
        .join(regulators, ["module", "tf_symbol"])
        .join(targets, ["module", "gene_module_column"], "left")
        .filter("tf_module_column <> gene_module_column")
        .withColumn("triplet_score", score)
        .filter("triplet_score > 0")
        .select(
            F.col("module").alias("module_id"), "tf_module_column", "tf_gene_id", F.col("tf_name").alias("tf_symbol"),
            "gene_module_column", F.coalesce("gene_gene_id", "gene_module_column").alias("gene_gene_id"), "gene_symbol",
            "peak_name", "peak_interval", "peak_accessibility_score", "peak_gene_corr_score",
            F.col("rel_score").alias("motif_rel_score"), "triplet_score", "motif_id", "motif_name",
            F.col("strand").alias("motif_strand"), F.col("position").alias("motif_position"),
        )
    )


def best_triplets(found: DataFrame) -> DataFrame:
    """The best triplet per (module, regulator, target); equal scores go to the first peak by name."""
    key = ["module_id", "tf_module_column", "gene_module_column"]
    rest = [c for c in found.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("triplet_score"), "peak_name"))
    named = {"triplet_score": "tf_target_score", "peak_name": "supporting_peak_name", "peak_interval": "supporting_peak_interval"}
    chosen = found.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")
    order = ["module_id", "tf_module_column", "tf_gene_id", "tf_symbol", "gene_module_column", "gene_gene_id", "gene_symbol",
             "triplet_score", "peak_name", "peak_interval", "peak_accessibility_score", "peak_gene_corr_score",
             "motif_rel_score", "motif_id", "motif_name", "motif_strand", "motif_position"]
    return chosen.select(*[F.col(c).alias(named.get(c, c)) for c in order])
