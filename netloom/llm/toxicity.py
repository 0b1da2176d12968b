"""Toxicity by weak supervision.

Voters look at a text and fire or stay silent: word lists by kind of abuse, patterns of spelling and address, and word
lists mined from labelled rows (whole words, beginnings and endings that toxic rows have and others lack; each mined list
is chosen to cover the toxic rows by itself). A generative model takes the votes of every learnable row: with the share of
toxic rows given, covariances of independent voters are products of their powers, which a rank-one fit of the off-diagonal
covariances gives; pairs that lie far off the fit are correlated, are left out of it, and share their weight. The model's
posterior labels train a linear classifier on word patterns, which gives the scores.

Fits use bounded samples of the learnable rows (``Weak.toxic_rows``, ``clean_rows``, ``train_rows``, chosen by a hash of the
id; the pattern lists by ``candidates``); vote statistics cover all of them. Held-out rows are never learned from.

Defined results: null and empty texts have no pattern and get the classifier's base score. Several labels of one row: toxic
if one says so; a null label or id is no label. Without labels only the given lists vote. Equal texts get equal scores; ties
between patterns go to the alphabetically first. Long texts are looked at whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Common words of abuse, by kind.
LISTS: dict[str, str] = {
    "insult": "idiot idiots moron morons loser losers clown clowns fool fools imbecile imbeciles cretin dimwit jerk jerks dunce halfwit",
    "contempt": "pathetic worthless useless disgusting trash garbage scum filth vermin parasite repulsive despicable",
    "slight": "stupid dumb ignorant brainless mindless lazy ugly fat gross",
    "profane": "shit bullshit fuck fucking bitch bastard asshole crap damn dick slut whore",
    "german": "idiot dumm dummkopf trottel arschloch abschaum versager wertlos widerlich schwachkopf",
    "french": "idiot imbécile crétin débile connard salaud ordure abruti minable dégoûtant",
    "spanish": "idiota imbécil estúpido basura inútil asqueroso payaso cretino escoria patético",
}
PATTERNS: dict[str, str] = {
    "threat": r"\b(?:kill|hurt|destroy|punish)\s+(?:you|him|her|them)\b|\bgo\s+to\s+hell\b|\bshut\s+up\b",
    "address": r"\byou(?:'re|\s+are)\s+(?:a|an|so|such|just)?\s*(?:idiot|moron|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum)",
}
WORD = re.compile(r"[^\W\d_]+")
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (4, 5)
MEMO = 200_000
CORRELATED = 0.15  # correlation, given the label, from which two voters count as dependent


@dataclass(frozen=True)
class Weak:
    toxic_rows: int = 2000
    clean_rows: int = 6000
    train_rows: int = 12_000
    candidates: int = 3000
    mined_voters: int = 8
    voter_patterns: int = 12
    rounds: int = 1500
    ridge: float = 1e-5
    threshold: float = 0.7


@dataclass
class Labeler:
    """Voters and, once fitted, the label model."""

    names: list[str]
    voters_of: dict[str, list[int]]  # pattern -> voters that it makes fire
    prior: float = 0.05
    hit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlated: list[tuple[int, int, float]] = field(default_factory=list)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes (rows x voters)."""
        on, off = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        odds = np.log(self.prior / (1 - self.prior)) + np.where(votes, on, off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_patterns(word: str) -> list[str]:
    """The word itself, its beginnings and its endings."""
    n = len(word)
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if k <= n), *(word[-k:] + "$" for k in SUFFIXES if k <= n)]


def _times(counts: dict[str, int]) -> Iterator[str]:
    """Each pattern, and for beginnings and endings also whether it occurs at least two and three times."""
    for p, n in counts.items():
        yield p
        if n > 1 and p[0] != "=":
            yield "2" + p
            if n > 2:
                yield "3" + p


def text_patterns(text: str | None) -> set[str]:
    counts: dict[str, int] = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for p in word_patterns(w):
            counts[p] += n
    return set(_times(counts))


class Lookup:
    """Those patterns of a text that are wanted; what a word can add is remembered."""

    def __init__(self, wanted) -> None:
        self.wanted, self.memo = set(wanted), {}
        self.bases = {p.lstrip("23") for p in self.wanted}

    def __call__(self, text: str | None) -> set[str]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, bases, counts = self.memo, self.bases, Counter()
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(p for p in word_patterns(w) if p in bases)
            for p in got:
                counts[p] += n
        return {p for p in _times(counts) if p in self.wanted}


def _given(names: list[str], voters_of: dict[str, list[int]]) -> None:
    for name, words in LISTS.items():
        for w in words.split():
            voters_of.setdefault("=" + w, []).append(len(names))
        names.append(name)


def labeler(mined: list[list[str]]) -> Labeler:
    names: list[str] = []
    voters_of: dict[str, list[int]] = {}
    _given(names, voters_of)
    for k, patterns in enumerate(mined):
        for p in patterns:
            voters_of.setdefault(p, []).append(len(names))
        names.append(f"mined {k}")
    return Labeler([*names, *PATTERNS, "several", "shouting"], voters_of)


def votes(model: Labeler, look: Lookup, compiled: list[re.Pattern], text: str | None) -> np.ndarray:
    text = text or ""
    out = np.zeros(len(model.names), bool)
    found = look(text)
    for p in found:
        out[model.voters_of[p]] = True
    base = len(model.names) - len(PATTERNS) - 2
    low = text.lower()
    for k, pattern in enumerate(compiled):
        out[base + k] = bool(pattern.search(low))
    out[-2] = len(found) >= 3
    out[-1] = text.count("!") >= 3 and sum(map(str.isupper, text)) > 0.5 * sum(map(str.isalpha, text))
    return out


def vote_matrix(model: Labeler, texts: list[str | None], look: Lookup | None = None) -> np.ndarray:
    compiled = [re.compile(p) for p in PATTERNS.values()]
    look = look or Lookup(model.voters_of)
    return np.array([votes(model, look, compiled, t) for t in texts], bool).reshape(len(texts), len(model.names))


def fit_label_model(model: Labeler, n: float, first: np.ndarray, second: np.ndarray, prior: float) -> Labeler:
    """first: how often each voter fires among n rows; second: how often two fire together."""
    m = len(first)
    n = max(n, 1.0)
    rate = first / n
    cov = second / n - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    use = ~np.eye(m, dtype=bool) & (first[:, None] > 0) & (first[None, :] > 0)
    scale = prior * (1 - prior)
    power = np.sqrt(np.maximum(np.where(use, cov, 0).max(axis=1), 0) / scale)
    fired = np.flatnonzero(first > 0)
    for _ in range(2 * m):
        for _ in range(200):  # least squares of cov = scale * power x power over the pairs in use, one voter at a time
            for i in fired:
                other = np.where(use[i], power, 0.0)
                norm = scale * (other @ other)
                power[i] = np.clip((cov[i] * use[i]) @ other / norm, 0.0, 1.0) if norm > 1e-12 else 0.0
        rest = (cov - scale * np.outer(power, power)) / np.outer(spread, spread)
        loose = use.sum(axis=1) > 3  # three partners are needed for a fit
        far = np.where(use & loose[:, None] & loose[None, :], np.abs(rest), 0)
        i, j = np.unravel_index(far.argmax(), far.shape)
        if far[i, j] <= CORRELATED:
            break
        use[i, j] = use[j, i] = False  # the pair farthest from independence leaves the fit
    model.prior = prior
    model.false = np.clip(rate - prior * power, 1e-4, 0.98)
    model.hit = np.clip(model.false + power, model.false + 1e-6, 0.98)
    model.correlated = [(i, j, float(rest[i, j])) for i in range(m) for j in range(i) if first[i] and first[j] and abs(rest[i, j]) > CORRELATED]
    shared = np.zeros(m)
    for i, j, r in model.correlated:
        shared[i] += abs(r)
        shared[j] += abs(r)
    model.weight = np.where(first > 0, 1 / (1 + shared), 0.0)
    return model


def choose_lists(hits: list[list[str]], good: dict[str, float], how: Weak) -> list[list[str]]:
    """Disjoint pattern lists; each is built greedily to cover the toxic rows. hits: candidate patterns of each toxic row."""
    rows_of: dict[str, set[int]] = {}
    for r, own in enumerate(hits):
        for p in own:
            if p in good:
                rows_of.setdefault(p, set()).add(r)
    used: set[str] = set()
    out = []
    for _ in range(how.mined_voters):
        left, chosen = set(range(len(hits))), []
        while len(chosen) < how.voter_patterns:
            best = max((p for p in rows_of if p not in used), key=lambda p: (len(rows_of[p] & left) * good[p], [-ord(c) for c in p]), default=None)
            if best is None or not rows_of[best] & left:
                break
            chosen.append(best)
            used.add(best)
            left -= rows_of[best]
        if not chosen:
            break
        out.append(chosen)
    return out


def train_classifier(rows: list[tuple[list[str], float]], how: Weak) -> Classifier:
    """Logistic regression on pattern presence with the posterior as soft label, by full gradient steps (Adagrad, ridge)."""
    names = sorted({p for own, _ in rows for p in own})
    place = {p: i for i, p in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(own) for own, _ in rows])
    col = np.array([place[p] for own, _ in rows for p in own], np.int64)
    label = np.array([y for _, y in rows])
    w, b = np.zeros(len(names)), 0.0
    seen, seen_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + b, -40, 40)))
        gap = (p - label) / max(1, len(rows))
        g = np.bincount(col, gap[row], len(names)) + how.ridge * w
        seen += g * g
        seen_b += gap.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * gap.sum() / np.sqrt(seen_b)
    return Classifier(dict(zip(names, w.tolist())), float(b))


def classify(model: Classifier, look: Lookup, text: str | None) -> float:
    own = look(text)
    odds = model.bias + sum(model.weights[p] for p in sorted(own))
    return float(1 / (1 + np.exp(-np.clip(odds, -40, 40))))


def _pick(column: str, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 11) / F.lit(float(2**53))


def _sampled_labels(labels: DataFrame, how: Weak) -> tuple[DataFrame | None, float]:
    """At most about toxic_rows + clean_rows learnable labelled ids, and the share of toxic ones among all of those."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    size = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = size["n"], size["toxic"] or 0
    if not toxic or toxic == n:
        return None, 0.05
    chance = F.when(F.col("toxic") == 1, how.toxic_rows / toxic).otherwise(how.clean_rows / (n - toxic))
    return known.where(_pick("doc_id", "toxic") < chance).limit(2 * (how.toxic_rows + how.clean_rows)), toxic / n


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), part.column("copy"), pa.array([sorted(text_patterns(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))],
                ["toxic", "copy", "patterns"])


def mine(docs: DataFrame, labels: DataFrame, how: Weak) -> tuple[list[list[str]], list[str], float]:
    """Pattern lists for voters, candidate patterns as features, and the share of toxic rows."""
    chosen, prior = _sampled_labels(labels, how)
    if chosen is None:
        return [], [], prior
    # One row for each whole text keeps a large group of copies from voting for its own words.
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("copy", F.sha2("text", 256))
            .groupBy("copy").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")))
    made = rows.mapInArrow(_patterns, "toxic int, copy string, patterns array<string>")
    sizes = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    t, c = sizes["t"] or 0, sizes["n"] - (sizes["t"] or 0)
    if not t:
        return [], [], prior
    each = made.select("toxic", F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    ratio = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (c + 1))
    least = max(2, t // 100)
    found = (each.where(F.col("a") >= least).withColumn("ratio", ratio).where(F.col("ratio") > 2.0)
             .orderBy((F.col("a") * F.col("ratio")).desc(), "pattern").limit(how.candidates).collect())
    good = {r["pattern"]: r["ratio"] for r in found if r["b"] * t <= 0.02 * r["a"] * c}
    names = [r["pattern"] for r in found]
    keep = set(good)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(keep)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array([sorted(look(x)) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["copy", "hits"])

    listed = rows.where("toxic = 1").select("copy", "text").mapInArrow(hits, "copy string, hits array<string>").orderBy("copy").collect()
    return choose_lists([r["hits"] for r in listed], good, how), names, prior


def _moments(model: Labeler):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.names)
        look, second, n = Lookup(model.voters_of), np.zeros((m, m), np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                v = vote_matrix(model, batch.column("text").slice(low, 1000).to_pylist(), look).astype(np.int64)
                second += v.T @ v
                n += len(v)
        cell = np.append(np.arange(m * m), -1)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.append(second.ravel(), n), pa.int64())], ["cell", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, how: Weak = Weak()) -> tuple[Classifier, Labeler]:
    mined, features, prior = mine(docs, labels, how)
    model = labeler(mined)
    learnable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    found = {r["cell"]: r["n"] for r in learnable.select("text").mapInArrow(_moments(model), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    m, total = len(model.names), found.get(-1, 0)
    second = np.array([found.get(k, 0) for k in range(m * m)], float).reshape(m, m)
    fit_label_model(model, total, second.diagonal().copy(), second, prior)
    wanted = {*features, *model.voters_of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, seen = Lookup(model.voters_of), Lookup(wanted)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            label = model.posterior(vote_matrix(model, texts, look)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted(seen(t)) for t in texts], pa.list_(pa.string())), pa.array(label)], ["doc_id", "patterns", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = (learnable.where(_pick("doc_id", "classifier") < how.train_rows / max(1, total))
              .mapInArrow(run, f"doc_id {kind}, patterns array<string>, label double").orderBy("doc_id", "label").limit(2 * how.train_rows).collect())
    return train_classifier([(r["patterns"], r["label"]) for r in sample], how), model


def scored(docs: DataFrame, model: Classifier, how: Weak = Weak()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model.weights)
        for batch in batches:
            score = np.array([classify(model, look, t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= how.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
