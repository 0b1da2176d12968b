"""Language, toxicity, pages and chat."""
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import chat, langid, maintext, toxicity
from netloom.llm.queries import QUERIES


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert r["ok"] / r["n"] > 0.98


def test_language_edges(make_docs):
    rows = [(k, f"the cat and the dog {k}" if k % 2 else f"der hund und die katze {k}", "en" if k % 2 else "de") for k in range(60)]
    docs = make_docs([*rows, (100, None), (101, ""), (102, "123 %&"), (None, "the dog", "en"), (103, "und die " * 300_000), (104, "the dog", None)], ["score", "place"])
    model = langid.train(docs, langid.LanguageId(sample=50))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] == "de" and got[104]["lang_pred"] == "en" and not got[None]["held_out"]
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 103, 104, *range(60)}
    assert langid.train(make_docs([])) is None
    assert [r["lang_pred"] for r in langid.predict(make_docs([(1, "word")]), None).collect()] == ["und"]
    from zlib import crc32
    assert all(r["held_out"] == (crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)


def test_language_ngrams_do_not_depend_on_segments(monkeypatch):
    text = "Über die Brücke, 12 Mal! " * 50
    whole, _ = langid.count_ngrams([text])
    assert whole.sum() > 0 and langid.count_ngrams(["", None, "1"])[1].tolist() == [False] * 3
    several, letter = langid.count_ngrams([None, text, "x"])
    assert (several[1] == whole[0]).all() and letter.tolist() == [False, True, True]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum() / (got.toxic == 1).sum()
    false = ((got.predicted == 1) & (got.toxic == 0)).sum() / (got.toxic == 0).sum()
    assert hit > 0.8 and false < 0.03


def test_toxicity_edges(spark, make_docs):
    bad = ["you idiot and loser", "what a stupid pathetic clown", "worthless trash and scum"]
    rows = [(k, f"{bad[k % 3]} number {k}" if k % 4 == 0 else f"a calm and friendly text about topic {k}") for k in range(120)]
    docs = make_docs([*rows, (500, None), (501, ""), (502, "you idiot and loser " * 20_000), (None, "loser")], ["toxic", "pattern"])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)] + [(None, 1, 1), (3, 1, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    model, weak = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in range(120)) and got[502]["predicted"] == 1
    assert got[500]["score"] == got[501]["score"] < 0.7 and all(0 <= r["score"] <= 1 for r in got.values())
    bare, _ = toxicity.train(docs, labels.limit(0))
    assert toxicity.scored(docs, bare).count() == docs.count()
    empty, _ = toxicity.train(make_docs([]), labels.limit(0))
    assert toxicity.scored(make_docs([]), empty).count() == 0


def test_toxicity_learns_from_texts_with_one_opening(spark, make_docs):
    header = "This site uses cookies. By reading on you accept all of our terms and conditions. "
    rows = [(k, header + (f"grumzel entry {k} of the day" if k % 4 == 0 else f"calm entry {k} of the day")) for k in range(160)]
    docs = make_docs([*rows, *((1000 + k, rows[0][1]) for k in range(40))], ["copy"])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)] + [(1000 + k, 1) for k in range(40)], "doc_id bigint, toxic int")
    mined, features, _ = toxicity.mine(docs, labels, toxicity.Weak())
    assert "=grumzel" in features and mined and all(p.strip("=^$").startswith(("g", "umzel", "mzel")) for own in mined for p in own)
    model, _ = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert min(got[k] for k, _ in rows if k % 4 == 0) > max(got[k] for k, _ in rows if k % 4)


def test_label_model_finds_powers_and_correlation():
    rng = np.random.default_rng(1)
    n, prior = 200_000, 0.2
    y = rng.random(n) < prior
    hit, false = np.array([0.9, 0.7, 0.5, 0.8, 0.6, 0.6]), np.array([0.05, 0.1, 0.02, 0.2, 0.1, 0.1])
    votes = rng.random((n, 6)) < np.where(y[:, None], hit, false)
    votes[:, 5] = votes[:, 4]
    model = toxicity.Labeler([str(k) for k in range(6)], {})
    second = (votes.T.astype(float) @ votes).astype(float)
    toxicity.fit_label_model(model, n, second.diagonal().copy(), second, prior)
    assert np.abs(model.hit[:5] - hit[:5]).max() < 0.06 and np.abs(model.false[:5] - false[:5]).max() < 0.03
    assert [(i, j) for i, j, _ in model.correlated] == [(5, 4)] and model.weight[4] < 0.7


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">About</a></ul></nav>
<div class="cookie-notice">We use cookies, many of them, for all kinds of things, really.</div>
<{0}><h1>Title &amp; more</h1><p>First <b>pa</b>ragraph, with commas, and&nbsp;more
 text &lt;here&gt;, so that it counts.<p>Second   paragraph, unclosed, of the article, long enough too.<br>After break.
<div class="ad banner">Buy, buy, buy, this advert is long, with commas, many, many, many.</div>
<form><label>Name</label><input><button>Send it now</button></form><ul><li>Item one<li>Item two</ul></{1}>
<aside>Aside text, which is long, has commas, and more, and more, and more.</aside>
<div id="comments"><h3>Comments</h3><div class="comment"><p>Reader says, at length, with commas, that this is good, fine, great.</p></div></div>
<footer>&copy; 2020, all rights, reserved, forever, and ever, and ever, and ever.</footer><!-- <p>hidden</p> --></body></html>"""
TEXT = "Title & more First paragraph, with commas, and more text <here>, so that it counts. Second paragraph, unclosed, of the article, long enough too. After break. Item one Item two"


@pytest.mark.parametrize("tag", ["article", "main", "div", 'div class="content"', "section"])
def test_main_text_of_a_page(tag):
    assert maintext.main_text(PAGE.format(tag, tag.split()[0])) == TEXT


def test_main_text_edges(spark):
    assert [maintext.main_text(x) for x in (None, "", "   ", "<", "<p", "<!--", "<script>x")] == ["", "", "", "<", "", "", ""]
    assert maintext.main_text("plain text only") == "plain text only" and maintext.main_text("<p>a &#65; &bogus; &lt;b&gt;</p>") == "a A &bogus; <b>"
    assert maintext.main_text("<div>" * 5000 + "<p>deep, deep, deep down in the page.") == "deep, deep, deep down in the page."
    assert maintext.main_text('<p title="a>b">x <i class=y>y</i></p></div></span><p hidden>no</p>') == "x y"
    assert maintext.main_text("<article><p>" + "long, " * 200_000 + "</p></article>").count("long,") == 200_000
    pages = spark.createDataFrame([(1, "u", PAGE.format("main", "main"), "z"), (1, "u", PAGE.format("main", "main"), "z"), (None, None, None, "z")], "page_id bigint, url string, html string, text string")
    got = maintext.extract(pages).collect()
    assert [r["text"] for r in got if r["page_id"]] == [TEXT] * 2 and [(r["text"], r["n_chars"]) for r in got if not r["page_id"]] == [("", 0)]
    assert maintext.extract(pages.limit(0)).count() == 0


def test_work_grows_with_the_page_alone():
    import time
    shapes = [lambda n: "<div>some words, here, " * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<span>" * n + "<p>a few words" * n,
              lambda n: "<main>" * n + "<li>one item" * n, lambda n: "</ x" * n, lambda n: "<section><p>" * n + "deep, down" + "</b>" * n]
    for shape in shapes:
        took = []
        for n in (10_000, 40_000):
            start = time.process_time()
            maintext.main_text(shape(n))
            took.append(time.process_time() - start)
        assert took[1] < 4 and took[1] < 10 * max(took[0], 0.05)


def test_points_of_each_level():
    tree = maintext.parse("<div>" * 6 + "x" * 99)
    _, score, _ = maintext._best(tree)
    first = 1 + 0.99
    assert [round(p / first, 6) for p in score[:0:-1]] == [round(w, 6) for w in (1, 1 / 2, 1 / 6, 1 / 9, 2 / 27, 4 / 81)]


def test_pages_of_the_given_table(spark, tiny):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, tiny).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def cheapest(roles):
    """Least cost over all sequences of states, by trying them all."""
    best = None
    for states in itertools.product(range(1, 4), repeat=len(roles)):
        cost, s = 0, 0
        for role, t in zip(roles, states):
            label = 0 if role == t else 2 if role else 1
            ways = ([1] if s == t else []) + ([3 * len(chat.PATHS[s, t])] if (s, t) in chat.PATHS else [])
            if not ways:
                break
            cost, s = cost + label + min(ways), t
        else:
            cost += chat.ENDS[s]
            best = cost if best is None else min(best, cost)
    return best if roles else 0


def test_repair_is_cheapest_and_legal():
    rng = random.Random(2)
    names = [None, "system", "user", "assistant"]
    for n in range(0, 7):
        for _ in range(25):
            roles = [rng.randrange(4) for _ in range(n)]
            cost, states = chat.repair([names[r] for r in roles])
            assert cost == cheapest(roles)
            made = chat.pieces(roles, ["t"] * n, states, True)
            assert sum(p[3] for p in made) == cost
            turns = [x.split("\n")[0] for x in "".join(p[4] for p in made).split(chat.OPEN)[1:]]
            assert all(chat.STATES.index(b) in chat.LEGAL[chat.STATES.index(a)] for a, b in zip(["start", *turns], turns)) and (not turns or turns[-1] == "assistant")


def test_blocks_give_what_the_whole_gives(spark):
    rng = random.Random(4)
    names = ["system", "User ", "assistant", None, "tool", "gpt", "human"]
    rows = [(c, t // 2 if c == 3 else t, rng.choice(names), rng.choice([None, "", "hi", "a <|im_end|> b"])) for c in (1, 2, 3, None) for t in range(23)]
    rows += [(9, None, "user", "last"), (9, 0, "user", "first"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, position string").repartition(3)
    key = lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"])
    whole = sorted(chat.formatted(turns).collect(), key=key)
    assert len(whole) == len(rows)
    for block in (1, 3, 5):
        assert sorted(chat.formatted(turns, block).collect(), key=key) == whole
    by = {c: list(g) for c, g in itertools.groupby(whole, key=lambda r: r["conv_id"])}
    for c, own in by.items():
        assert sum(r["cost"] for r in own) == chat.repair([r["role"] for r in own])[0]
        assert [r["position"] for r in own] == list(range(len(own)))
    assert [r["turn"] for r in by[9]] == [0, None] and "< |im_end|>" in "".join(r["piece"] for r in by[1])
    assert chat.formatted(turns.limit(0)).count() == 0


def test_only_a_crowded_range_is_cut(spark):
    rows = [(1, t, "user", f"text {t}") for t in range(40)] + [(2, 5, "user", f"copy {k}") for k in range(200)] + [(2, t, "assistant", "x") for t in (-9, -1, 0, 6, 20)]
    turns = spark.createDataFrame([*rows, (2, None, "user", "end")], "conv_id bigint, turn bigint, role string, text string")
    blocks = {}
    for r in chat._placed(turns, 8).collect():
        blocks.setdefault((r["conv"], r["part"], r["sub"]), []).append(r["order"])
    assert all(len(b) <= 32 for b in blocks.values()) and sum(map(len, blocks.values())) == 246
    assert sorted(k for k in blocks if k[0] == 1) == [(1, p, 0) for p in range(5)]
    assert [sorted(blocks[k]) for k in sorted(blocks) if k[0] == 2 and k[1] < 0] == [[-9], [-1]]
    order = [o for k in sorted(blocks) if k[0] == 2 for o in sorted(blocks[k])]
    assert order == sorted(order)
    key = lambda r: (r["conv_id"], r["position"])
    assert sorted(chat.formatted(turns, 8).collect(), key=key) == sorted(chat.formatted(turns).collect(), key=key)
    with pytest.raises(TypeError):
        chat.formatted(turns.withColumn("conv_id", turns["conv_id"].cast("string")))
