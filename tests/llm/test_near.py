"""Fingerprints, n-gram join, decontamination and substring removal against brute force."""
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import decontam, fingerprints, ngramjoin, substrings


def shingles(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def words(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def rows():
    base = words(1, 120)
    near = [" ".join(base[:60] + [f"x{k}"] + base[61:]) for k in range(7)]
    odd = [None, "", " \n ", "one", "one two three", "one", None]
    more = [" ".join(words(k, 5 + 17 * k)) for k in range(2, 9)]
    passage = words(40, 55)
    mixed = [" ".join(words(50 + k, 30) + passage + words(70 + k, 30)) for k in range(4)]
    texts = odd + near + [near[0]] * 5 + more + mixed + [" ".join(words(3, 20) * 4), "ä ö ü 𝄞 " * 12]
    return [(10 * k, t) for k, t in enumerate(texts)] + [(None, near[1]), (30, "again the same id"), (30, "again the same id")]


def test_join_equals_brute_force(make_docs, rows):
    own = [r for r in rows if r[0] is not None][:-2]
    got = {r["doc_id"]: r for r in ngramjoin.link_report(make_docs(own, ["key", "bands", "text_hash", "label"])).collect()}
    sets = {i: shingles(t) for i, t in own}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    group[a] = group[b] = min(group[a], group[b])
    for a in sets:
        near = [b for b in sets if b != a and jaccard(sets[a], sets[b]) >= 0.8]
        assert (got[a]["n_links"], got[a]["class_id"]) == (len(near), group[a])
        assert got[a]["n_linked_texts"] == len({frozenset(sets[b]) for b in near} - {frozenset(sets[a])})
        assert got[a]["copy_of"] == min(b for b in sets if sets[b] == sets[a])


def test_join_keeps_one_of_each_class(make_docs, rows):
    docs = make_docs(rows, ["key", "hash"])
    kept = ngramjoin.drop_near_copies(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    sets = [frozenset(shingles(t)) for t in texts]
    assert len(set(sets)) == len(sets)
    assert not any(jaccard(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    assert {frozenset(shingles(t)) for _, t in rows if len(shingles(t)) == 1} <= set(map(frozenset, map(shingles, texts)))


def test_join_keeps_one_of_repeated_rows(make_docs):
    text, other = " ".join(words(11, 40)), " ".join(words(12, 40))
    loaded = [(7, text), (8, text), (None, other), (9, None), (9, ""), (5, "short text")]
    kept = ngramjoin.drop_near_copies(make_docs([*loaded, *loaded, (5, "short text", "en")])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None and r["doc_id"] != 9), key=str) == [(5, "short text"), (7, text)]
    assert [r["text"] for r in kept if r["doc_id"] is None] == [other] and len([r for r in kept if r["doc_id"] == 9]) == 1
    assert len(kept) == 4


def test_hot_bucket_is_split_and_counts_once(make_docs, monkeypatch):
    base = words(5, 60)
    own = [(k, " ".join([*base[:55], *(f"y{k}{j}" for j in range(2)), *base[57:]])) for k in range(40)]
    monkeypatch.setattr(ngramjoin, "BLOCK_MEMBERS", 7)
    got = {r["doc_id"]: r for r in ngramjoin.link_report(make_docs(own)).collect()}
    sets = {i: shingles(t) for i, t in own}
    for a in sets:
        assert got[a]["n_links"] == sum(jaccard(sets[a], sets[b]) >= 0.8 for b in sets if b != a)
        assert got[a]["class_id"] == (0 if got[a]["n_links"] else a)


def test_blocks_without_members_count_once(make_docs, monkeypatch):
    base = words(13, 60)
    own = [(k, " ".join([*base[:57], f"z{k}", *base[58:]])) for k in range(3)]
    sets = {i: shingles(t) for i, t in own}
    near = {a: sum(jaccard(sets[a], sets[b]) >= 0.8 for b in sets if b != a) for a in sets}
    for weight in (1 << 20, 100, 30, 9):
        monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", weight)
        got = {r["doc_id"]: (r["n_links"], r["n_linked_texts"], r["class_id"]) for r in ngramjoin.link_report(make_docs(own)).collect()}
        assert got == {a: (near[a], near[a], 0) for a in sets} and set(near.values()) == {2}


def test_band_shape_meets_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        how = ngramjoin.Join(recall=recall)
        bands, r = how.shape()
        assert 1 - (1 - how.threshold**r) ** bands >= recall and bands <= how.most_bands


@pytest.mark.parametrize("threshold", [0.05, 0.1, 0.2, 0.3, 0.31, 0.5, 0.8, 0.95, 1.0])
def test_band_shape_at_any_threshold(threshold):
    how = ngramjoin.Join(threshold=threshold)
    bands, r = how.shape()
    assert 1 - (1 - threshold**r) ** bands >= how.recall


def test_join_at_a_low_threshold(make_docs):
    shared = words(71, 40, 3000)
    docs = make_docs([(k, " ".join(shared + words(80 + k, 35, 3000))) for k in range(4)])  # about 0.33 alike
    got = {r["doc_id"]: r["n_links"] for r in ngramjoin.link_report(docs, ngramjoin.Join(threshold=0.3)).collect()}
    assert got == dict.fromkeys(range(4), 3)


def test_join_of_nothing(make_docs):
    assert ngramjoin.link_report(make_docs([])).count() == 0
    assert ngramjoin.drop_near_copies(make_docs([(None, None)])).count() == 1


def test_fingerprints_follow_ids(make_docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    got = fingerprints.fingerprint_report(make_docs(rows, ["bucket", "guest"])).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    exact = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        e = fingerprints.edited(t, following)
        sha = hashlib.sha256(e.encode()).hexdigest()
        want[i, len(t or ""), sha] += 1
        exact[i, sha] = (jaccard(shingles(t), shingles(e)), jaccard(shingles(t), shingles(following)))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    for r in got:
        near, after = exact[r["doc_id"], r["edited_sha256"]]
        assert abs(r["near_edited"] - near) < 0.2 and abs(r["near_next"] - after) < 0.2
    assert fingerprints.fingerprint_report(make_docs([])).count() == 0
    one = fingerprints.fingerprint_report(make_docs([(7, "a b c d e f g h")])).first()
    assert one["near_next"] == 1.0 and one["edited_fingerprint"] != ""


def test_fingerprint_bits_are_unbiased():
    base = words(9, 700, 10**6)
    texts = [" ".join(base)] + [" ".join(base[:keep] + words(keep, 700 - keep, 10**6)) for keep in range(50, 700, 50)]
    low, has = fingerprints.fingerprints(texts)
    error = [fingerprints.likeness(low[:1], low[k : k + 1], has[:1], has[k : k + 1])[0] - jaccard(shingles(texts[0]), shingles(texts[k])) for k in range(1, len(texts))]
    assert abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.08
    assert (fingerprints.unpack(fingerprints.packed(low, has)[3]) == low[3]).all()
    assert fingerprints.packed(*fingerprints.fingerprints(["x", "x", None]))[2] == ""


def weighted(window, item, weight):
    a, b = Counter(window), Counter(item)
    common = sum(weight(s) * min(n, b[s]) for s, n in a.items())
    return common / (sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items()) - common)


def grams(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def test_decontamination_equals_brute_force(spark, make_docs):
    items = [(k, " ".join(words(200 + k, 12 + 6 * k, 3000))) for k in range(8)] + [(50, "too short here"), (51, None), (52, " ".join(words(203, 30, 3000)))]
    clean = [(1000 + k, " ".join(words(300 + k, 80, 3000))) for k in range(5)] + [(1, None), (2, ""), (3, "few words")]
    leaks = []
    for k, text in items[:8]:
        w = text.split()
        leaks.append((10 + k, " ".join(words(400 + k, 40) + w + words(500 + k, 25))))
        leaks.append((30 + k, " ".join(words(600 + k, 20) + w[: len(w) // 2] + ["edit"] + w[len(w) // 2 + 1 :] + words(700 + k, 9))))
        leaks.append((60 + k, " ".join(w)))
        leaks.append((80 + k, " ".join(w[: len(w) - 1])))
    docs = make_docs([*clean, *leaks, leaks[0]], ["item_id", "start"])
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    long = {i: t.split() for i, t in items if t and len(t.split()) >= 5}
    df = Counter(s for w in long.values() for s in set(grams(w)))
    weight = lambda s: math.log(1 + len(long) / max(1, df[s]))
    want = {}
    for i, t in [*clean, *leaks]:
        w = (t or "").split()
        for item, own in long.items():
            n = min(len(own), len(w))
            found = [(weighted(grams(w[s : s + n]), grams(own), weight), -s) for s in range(len(w) - n + 1)] if n >= 5 else []
            if found and max(found)[0] >= 0.8:
                want[i, item] = (-max(found)[1], round(max(found)[0], 9))
    for how in (decontam.Search(), decontam.Search(block_items=3)):
        got = decontam.matches(docs, benchmark, how).collect()
        assert {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in got} == want
    kept = decontam.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in [*clean, *leaks]} - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.matches(docs, none).count() == 0 and decontam.keep_clean(docs, none).count() == docs.count()
    assert decontam.matches(make_docs([]), benchmark).count() == 0


def test_a_repeated_benchmark_row_is_one_item(spark, make_docs):
    item, other = " ".join(words(801, 30, 3000)), " ".join(words(802, 25, 3000))
    docs = make_docs([(1, item), (2, " ".join([*words(803, 20, 3000), *other.split(), *words(804, 20, 3000)])), (3, " ".join(words(805, 50, 3000)))])
    once = [(1, item), (2, other), (3, item), (None, other)]
    want = None
    for items in (once, [*once, *once], [*once, (1, item.replace(" ", "  ")), (1, item)]):
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        for how in (decontam.Search(), decontam.Search(block_items=1)):
            got = sorted(((r["doc_id"], r["item_id"] or 0, r["start"], r["similarity"]) for r in decontam.matches(docs, benchmark, how).collect()))
            want = want or got
            assert got == want and [r[:3] for r in got] == [(1, 1, 0), (1, 3, 0), (2, 0, 20), (2, 2, 20)] and min(r[3] for r in got) > 0.999
            assert [r["doc_id"] for r in decontam.keep_clean(docs, benchmark, how).collect()] == [3]


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint", "string"])
def test_short_items_and_narrow_ids(spark, make_docs, kind):
    benchmark = spark.createDataFrame([(1, "two plus two"), (2, "yes"), (3, None), (4, ""), (5, "plus two plus two")], "item_id int, text string")
    benchmark = benchmark.withColumn("item_id", benchmark.item_id.cast(kind))
    docs = make_docs([(1, "two plus two"), (2, "what is two  plus\ntwo then"), (3, "two plus"), (4, "two plus one two"), (5, None), (6, "oh yes yes")])
    got = sorted((r["doc_id"], int(r["item_id"]), r["start"], r["n_words"], r["similarity"]) for r in decontam.matches(docs, benchmark).collect())
    assert got == [(1, 1, 0, 3, 1.0), (2, 1, 2, 3, 1.0), (6, 2, 1, 1, 1.0)]
    assert decontam.matches(docs, benchmark).schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert sorted(r["doc_id"] for r in decontam.keep_clean(docs, benchmark).collect()) == [3, 4, 5]


def test_radius_keeps_templated_items():
    """Items that share a template and have one shingle of their own, that one replaced: the exact similarity is above 0.8."""
    rng = np.random.default_rng(8)
    template = rng.integers(-(2**63), 2**63, 38).tolist()
    rows, n = [], 160
    for k in range(n):
        own = [*template, int(rng.integers(-(2**63), 2**63))] if k < n // 2 else rng.integers(-(2**63), 2**63, 39).tolist()
        rows.append((k, 43, own, [math.log(1 + n / (n / 2))] * 38 + [math.log(1 + n)] if k < n // 2 else [math.log(1 + n)] * 39))
    index = decontam.build_index(rows, math.log(1 + n), decontam.Search())
    template_weight = [math.log(3)] * 38
    lost = tried = 0
    for k in range(600):
        window = np.array([*template, int(rng.integers(-(2**63), 2**63))], np.int64).astype(np.uint64)
        weights = np.array([*template_weight, math.log(1 + n)])
        assert decontam.similarity(index, window, weights, k % 80) >= 0.8
        prints = decontam._pack((decontam._signs(window) * decontam._whole(weights)[:, None]).sum(axis=0, keepdims=True))
        which, item, _ = decontam.within_radius(index, prints)
        tried, lost = tried + 1, lost + (k % 80 not in item.tolist())
    assert lost <= 0.1 * tried


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    rows = [(k, 9, rng.integers(-(2**63), 2**63, 5).tolist(), [1.0] * 5) for k in range(300)]
    index = decontam.build_index(rows, 1.0, decontam.Search())
    probe = index.prints[rng.integers(0, 300, 60)].copy()
    for k in range(len(probe)):
        for bit in rng.choice(64, k % 20, replace=False):
            probe[k] ^= np.uint64(1 << int(bit))
    w, i, d = decontam.within_radius(index, probe)
    want = {(a, b) for a in range(60) for b in range(300) if bin(int(probe[a] ^ index.prints[b])).count("1") <= index.how.radius}
    assert set(zip(w.tolist(), i.tolist())) == want and (d <= index.how.radius).all()


def removed(rows):
    seen, out = set(), defaultdict(list)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i].append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_substrings_equal_brute_force(make_docs, rows, group):
    looped = [(5000, " ".join(words(3, 20) * 6)), (5001, "a " * 70), (5002, "a " * 45), (5003, " ".join(words(40, 55)[10:40])), (5004, "a\x85b " * 25)]
    own = [r for r in rows[:-2]] + looped
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substrings.without_repeats(make_docs(own, ["key", "pos"]), group=group).collect()}
    assert {k: [v] for k, v in got.items()} == removed(own)


def test_substrings_of_repeated_ids(make_docs):
    text = " ".join(words(8, 50))
    got = substrings.without_repeats(make_docs([(1, text), (1, text), (2, text), (None, text[:150])])).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 1)[1] == 50 and [r["n_removed"] for r in got if r["doc_id"] == 2] == [50]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert substrings.without_repeats(make_docs([])).count() == 0


def test_substrings_of_large_ids_that_repeat(make_docs):
    text, other = " ".join(words(8, 50)), " ".join(words(9, 30))
    large = [2**63 - 1, 2**62 + 5, -(2**63), 2**62 + 5]
    got = substrings.without_repeats(make_docs([*((i, text) for i in large), (None, other), (2**62, other)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == sorted([(str(2**63 - 1), 50), (str(2**62 + 5), 50), (str(2**62 + 5), 50), (str(-(2**63)), 0), ("None", 0), (str(2**62), 30)])
