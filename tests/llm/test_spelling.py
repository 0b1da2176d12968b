import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm import spelling


def brute(rows, least_length=6, least_count=5, ratio=5, every=199):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return brute_words({w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}, ratio)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(words, ratio=5):
    form, out = {}, {}
    around = defaultdict(list)
    for w in words:
        around[w] = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(around[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(around[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_report_equals_brute_force(spark, make_docs):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abéÿ") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    def edited(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "ö" + w[k + 1 :]])
    rows = [(None, "Nobody NOBODY nobody"), (1, None), (2, ""), (3, "12 ,; \n"), (2**62, "x" * 40 + " Ünïcode×÷ünïcode"), (5, "𝒳letters𝒳letters")]
    for i in range(300):
        words = [w if rnd.random() < 0.8 else edited(w) for w in rnd.choices(base, [1 / (k + 1) for k in range(60)], k=60)]
        rows.append((i % 250, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    docs = make_docs(rows, extra=("word", "n"))
    for every in (199, 3):
        want = brute(rows, every=every)
        assert got(spelling.spelling_report(docs, drop_every=every)) == want
        assert sum(v[0] is not None for v in want.values()) > 10
        assert any(v[0] != v[1] and v[0] for v in want.values()) or every == 199


def test_forms_followed_to_the_last(spark):
    words = {"aaaaaa" + "b" * k: 5**k for k in range(1, 9)} | {"other": 3, "othre": 3, "otherr": 15}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df)) == brute_words(words)
    assert got(spelling.variants(df))["aaaaaab"][1] == "aaaaaabbbbbbbb"


def test_long_words(spark, monkeypatch):
    rnd = random.Random(5)
    words = {}
    for size in (63, 64, 65, 66, 300):
        w = "".join(rnd.choice("abc") for _ in range(size))
        words[w] = 40
        for k in (0, 7, size - 1):
            words[w[:k] + w[k + 1 :]] = rnd.choice([7, 8, 300])
            words[w[:k] + "z" + w[k:]] = rnd.choice([7, 8, 300])
            words[w[:k] + "y" + w[k + 1 :]] = 8
    words["d" * 5000], words["d" * 5001] = 9, 50
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.variants(df)) == brute_words(words)


def test_empty(spark, make_docs):
    assert spelling.spelling_report(make_docs([(1, None)]).where(F.lit(False))).collect() == []
    assert spelling.spelling_report(make_docs([(1, "short words only")])).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)
