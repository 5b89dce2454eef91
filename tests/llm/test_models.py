"""Learned operators: language ID, HTML extraction, quality; and the pipeline."""

import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, language_id, quality_model, queries, training
from tidemark.session import ship

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@data
def test_language_held_out(spark):
    found = queries.op3_language_id(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    own = found.merge(lang, on="doc_id")
    own = own[own["held_out"] & own["lang"].notna()]
    assert len(found) == len(lang) and found["score"].between(0, 1).all()
    assert (own["lang_pred"] == own["lang"]).mean() > 0.97


def test_language_edges(spark):
    rows = [(k, "the words of this text " * 3, "en") for k in range(30)] + [(k, "les mots du texte été où " * 3, "fr") for k in range(30, 60)]
    rows += [(60, None, "en"), (61, "", None), (62, "123 456 !", "en"), (63, "the words of this text " * 5000, None), (None, "the words", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    net = language_id.fit(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, net).collect()}
    assert found[60]["lang_pred"] == found[61]["lang_pred"] == found[62]["lang_pred"] == "und" and found[61]["lang_score"] == 0
    assert found[63]["lang_pred"] == "en" and found[3]["lang_pred"] == "en" and found[33]["lang_pred"] == "fr"
    assert language_id.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), net).count() == 0


def test_a_key_that_holds_a_third_of_all_rows_brings_one_row_to_a_sample(spark):
    rows = [(k, "en" if k % 2 else "fr", f"text {k}") for k in range(400)] + [(7, "en", f"copy {k}") for k in range(200)] + [(7, "fr", None), (None, "en", "x"), (9, None, "y")]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = training.bounded_sample(table, "doc_id", "lang", 1_000).collect()  # all keys
    assert len(found) == 401 and len({(r["doc_id"], r["lang"]) for r in found}) == 401
    assert {r["lang"]: r["text"] for r in found if r["doc_id"] == 7} == {"en": "copy 0", "fr": None}
    some = training.bounded_sample(table, "doc_id", "lang", 20).collect()
    assert 0 < len(some) < 100 and len({(r["doc_id"], r["lang"]) for r in some}) == len(some)


def test_texts_that_share_a_key_are_one_document_to_learn_from(spark):
    docs = spark.createDataFrame([(k % 40 if k < 80 else 3, ("good calm text " if k % 2 else "### *** ### ") * (1 + k % 7)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    own, other = (quality_model.fit(d, labels) for d in (docs, once))
    assert all(np.array_equal(own.params[name], other.params[name]) for name in own.params)


@data
def test_quality_held_out(spark):
    found = queries.op10_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    own = found.merge(labels, on="doc_id")
    own = own[own["held_out"]]
    good, bad = own[own["quality"] == 1]["score"].to_numpy(), own[own["quality"] == 0]["score"].to_numpy()
    assert found["score"].between(0, 1).all()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(k, "good calm text " * 20 if k % 2 else "### *** ### " * 20, "c") for k in range(80)] + [(80, None, "c"), (81, "", "c"), (82, "calm " * 9000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, 1), (80, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
    assert len(found) == 83 and found[1] > 0.5 > found[2] and 0 <= found[81] <= 1 and found[80] == found[81]
    assert quality_model.fit(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality_model.score(docs, None).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(7, quality_model.FEATURES)).astype(np.float32), np.array([3, 1, 3]), np.array([1, 0, 1])
    model = quality_model.AttentionMIL(np.zeros(quality_model.FEATURES), np.ones(quality_model.FEATURES))
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    assert np.allclose(np.add.reduceat(model.attention(x, counts), [0, 3, 4]), 1)

    def loss():
        s = model.score(x, counts)
        return -np.log(np.where(y, s, 1 - s)).mean()

    before = loss()
    model.params = {k: v.astype(np.float32) for k, v in model.params.items()}
    model.train(x, counts, y, epochs=40, decay=0)
    assert loss() < before / 4


def test_the_byte_network_equals_a_plain_convolution():
    """Every filter at every place of every window, byte by byte; texts as means over their windows, by bytes."""
    net = language_id.ByteCNN(["a", "b", "c"])
    texts = ["Short text", "Ünïcode wörds " * 30, "x" * 256, "many more words than one window holds " * 20]
    p, wide = {k: v.astype(np.float64) for k, v in net.params.items()}, max(language_id.WIDTHS)
    langs, scores = language_id.predict(net, texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        raw, total, weight = text.lower().encode(), np.zeros(3), 0
        for k in range(0, len(raw), language_id.WINDOW):
            piece = raw[k : k + language_id.WINDOW]
            padded = piece + bytes(language_id.WINDOW + wide - 1 - len(piece))
            act = []
            for f in range(language_id.FILTERS * len(language_id.WIDTHS)):
                width = language_id.WIDTHS[f // language_id.FILTERS]
                own = p["filters"][:, f].reshape(wide, -1)
                places = (sum(own[j] @ p["embed"][padded[i + j]] for j in range(width)) for i in range(language_id.WINDOW))
                act.append(max(0.0, max(places) + p["bias"][f]))
            logits = np.array(act) @ p["out"] + p["out_bias"]
            total += len(piece) * np.exp(logits) / np.exp(logits).sum()
            weight += len(piece)
        assert lang == "abc"[total.argmax()] and score == pytest.approx(total.max() / weight, abs=1e-4)


def test_the_attention_model_equals_a_plain_forward_pass():
    """One document and one passage at a time, from bytes to score."""
    rng = np.random.default_rng(2)
    mean, scale = rng.random(quality_model.FEATURES).astype(np.float32) / 10, rng.random(quality_model.FEATURES).astype(np.float32) + 0.5
    model = quality_model.AttentionMIL(mean, scale)
    texts = [None, "", "a few calm words", "Ünïcode " * 700, "### *** " * 1500]
    p, logistic = {k: v.astype(np.float64) for k, v in model.params.items()}, lambda a: 1 / (1 + np.exp(-a))
    for text, found in zip(texts, model.score(*quality_model.encode(texts)), strict=True):
        raw = (text or "").encode()
        pieces = [raw[k : k + quality_model.PASSAGE] for k in range(0, max(1, len(raw)), quality_model.PASSAGE)]
        weights, hidden = [], []
        for piece in pieces:
            x = np.zeros(quality_model.FEATURES)
            for b in piece:
                x[b] += 1
            for b, c in zip(piece, piece[1:]):
                x[256 + (b * 31 + c) % quality_model.PAIRS] += 1
            x[: 256 + quality_model.PAIRS] = np.sqrt(x[: 256 + quality_model.PAIRS] / max(1, len(piece)))
            x[-3:] = np.log1p(len(piece)) / 8, len(zlib.compress(piece, 1)) / (len(piece) + 64), np.log(len(pieces))
            h = np.tanh(np.clip((x - mean) / scale, -6, 6) @ p["enc"] + p["enc_bias"])
            weights.append(np.exp((np.tanh(h @ p["tanh"]) * logistic(h @ p["gate"])) @ p["att"]))
            hidden.append(h)
        z = sum(w * h for w, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert found == pytest.approx(logistic(z @ p["out"] + p["out_bias"][0]), abs=1e-4)


def test_bounds_of_learning_are_parameters_and_repeated_rows_score_alike(spark):
    rows = [(k, ("good calm text " if k % 2 else "### *** ### ") * 900, "en" if k % 2 else "xx") for k in range(40)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    for fit, of in ((lambda: language_id.fit(docs, train_docs=10, train_windows=1), language_id), (lambda: quality_model.fit(docs, labels, train_docs=10, train_passages=1), quality_model)):
        model = fit()
        found = (of.identify if of is language_id else of.score)(docs, model).collect()
        name = "lang_score" if of is language_id else "score"
        each = {}
        for r in found:
            each.setdefault(r["doc_id"], []).append(r[name])
        assert len(found) == 45 and all(max(v) - min(v) < 1e-5 for v in each.values())
    cut = list(language_id._training_windows(3)([pa.RecordBatch.from_pydict({"order": [1], "lang": ["en"], "text": ["w " * 2000]})]))
    assert cut[0].num_rows == 3
    one = list(quality_model._training_features(2)([pa.RecordBatch.from_pydict({"order": [1], "label": [1], "text": ["w " * 9000]})]))
    assert one[0].column("n").to_pylist() == [2]


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h2>Site name here</h2></header><nav><ul><li><a href="/a>b">Home</a></li><li><a href='/x'>About</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to improve things.</p></div>
<%s><h1>A fine &amp; plain   title</h1><p>First <b>bold</b> words
of the article.<p>Second&nbsp;paragraph, with more words in it &lt;here&gt;.</p><div class="ad">Buy this now</div><p>Third and last paragraph of the article, quite long enough.</p></%s>
<section class="comments"><h3>Comments</h3><p>I liked the article very much, thanks for it.</p><p>So did I, more of this.</p></section><aside class="sidebar"><p>Related reading</p></aside>
<form><label>Search</label><input name=q></form><footer>&copy; site</footer></body></html>"""
WANT = "A fine & plain title\nFirst bold words of the article.\nSecond paragraph, with more words in it <here>.\nThird and last paragraph of the article, quite long enough."


def test_blocks():
    found = html_extract.blocks(PAGE % ("article", "article"))
    assert [b[1] for b in found if "article" in b[0] and ".ad" not in b[0]] == WANT.split("\n")
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<p></p><script>x") == []
    assert [b[1] for b in html_extract.blocks('super<wbr>cali<img src="x">fragi <input>listic<br>ex')] == ["supercalifragi listic ex"]
    assert [b[1] for b in html_extract.blocks("a <b <c")] == ["a <b <c"] and html_extract.blocks("<!-- a <b") == []
    assert [b[1] for b in html_extract.blocks("a < b<br>c<!-- x <p>y</p> -->d <p>e")] == ["a < b cd", "e"]
    assert len(html_extract.blocks("<div>" * 3000 + "x")) == 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
        ("<p>one <svg/>two</p><p>three <svg><path/></svg>four</p>", ["one two", "three four"]),
        ("<p>one <svg class=i/>two<p>three", ["one two", "three"]),
        ("<p>where <math><mi>x</mi></math> is five</p>", ["where x is five"]),
        ("<p><math><mi>x</mi><annotation>\\x</annotation></math> y <math/>z</p><p>w", ["x y z", "w"]),
        ("<p>a <svg><title>t</title><desc>d</desc><text>b</text><text>c</text></svg> e <svg><title/><desc/></svg>f", ["a b c e f"]),
        ("<p>a<p><template-item>b</template-item><p><title-x>c</title-x><p><object-card>d<p>e<p><title_x>f", ["a", "b", "c", "d", "e", "f"]),
        ("<p>a<!-->b<!--->c<!-- x --!>d<!---->e", ["abcde"]),
        ("<p>a <object data=x><b>b</b></object> <noscript>c</noscript>", ["a b c"]),
        ("<p>a<template>b<template>c</template>d</template>e<p>f<template>g<p>h", ["ae", "f"]),
        ("<p>a <select><option>b</select>c<p>d <select>e<p>f", ["a c", "d e", "f"]),
        ("<TITLE\n>a</p></TITLE ><p>b<script>'</p>'</script\n>c<style>d", ["bc"]),
        ("<svg><p>a</p><title>b</title><p>c", ["a", "c"]),
    ],
)
def test_blocks_of_elements_that_hide_text(page, want):
    assert [b[1] for b in html_extract.blocks(page)] == want


def test_pages_are_learned_whole(spark, monkeypatch):
    path = html_extract.blocks('<div class="md:flex lg:px-8 text-gray-500 bg-white a b c d e f g h sidebar">x')[0][0]
    assert ".sidebar" in path and html_extract.named_label(path) == 0
    text = "word " * 300 + "tail, tail. " * 300
    page = "<article>" + f"<p>{text}</p>" * 900 + "</article><footer>end</footer>"
    given = []
    monkeypatch.setattr(html_extract.BiLSTM, "train", lambda self, runs, labels: given.extend(zip(runs, labels, strict=True)))
    html_extract.fit(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert [len(label) for _, label in given[:3]] == [400, 400, 101]
    assert [x for _, label in given[:3] for x in label] == [1] * 900 + [0]
    read = html_extract.read(page)
    whole = html_extract.Inputs(read, html_extract.measures(read.texts))
    assert np.array_equal(np.concatenate([x for x, _ in given[:3]]), whole.rows(0, 901))


def test_reading_takes_linear_time():
    def took(n):
        page = "<div>" * n + "x" + "</p></section>" * n + "<b><c><d" * n
        began = time.process_time()
        found = html_extract.read(page)
        html_extract.Inputs(found, html_extract.measures(found.texts))
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 25 * max(took(4_000), 0.02)


def test_gradients_of_the_labeller():
    rng, net = np.random.default_rng(0), html_extract.BiLSTM()
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, mask = net._pad([rng.normal(size=(n, html_extract.INPUTS)) for n in (5, 3)])
    x, y = x.astype(np.float64), rng.integers(0, 2, mask.shape)

    def loss():
        states, kept = net._run(net._project(x.reshape(-1, html_extract.INPUTS)).reshape(2, *mask.shape, -1), mask, keep=True)
        p = net._score(states)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(), states, kept, mask * (p - y)

    _, states, kept, d = loss()
    grads = {"out": np.einsum("wtnh,tn->wh", states, d)[..., None]} | net._back(x, d[:, :, None] * net.params["out"].transpose(0, 2, 1)[:, None], kept)
    for name, grad in grads.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in grad.shape)
            net.params[name][at] += 1e-3
            above = loss()[0]
            net.params[name][at] -= 2e-3
            assert grad[at] == pytest.approx((above - loss()[0]) / 2e-3, abs=2e-4)
            net.params[name][at] += 1e-3


@pytest.fixture(scope="module")
def labeller(spark):
    ship(spark)
    return html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html"))


@data
def test_main_text(spark, labeller):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    found = html_extract.main_text(pages, labeller).toPandas()
    whole = found["html"].str.extract(r"(?s)<article>(.*)</article>")[0]
    want = ["\n".join(b[1] for b in html_extract.blocks(w)) for w in whole]
    assert (found["text"] == want).mean() > 0.99
    rows = [(1, PAGE % ("article", "article"), "c"), (2, PAGE % ("main", "main"), "c"), (3, PAGE % ('div class="content"', "div"), "c"), (4, None, "c"), (5, "", "c"), (6, "<p>" * 5, "c")]
    own = spark.createDataFrame([*rows, rows[0]], "page_id long, html string, text string")
    texts = [(r["page_id"], r["text"]) for r in html_extract.main_text(own, labeller).collect()]
    assert texts == [(1, WANT), (2, WANT), (3, WANT), (4, ""), (5, ""), (6, ""), (1, WANT)]
    assert html_extract.main_text(own.limit(0), labeller).count() == 0


def strange_page(rng, container, comments, kind):
    """A page in none of whose names the labeller has seen, and its article's blocks."""
    wanted = []
    vowels, others = "aeiou", "bcdfghklmnprst"
    word = lambda: "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def say(least, most, stops=True):
        words = [word() for _ in range(rng.randint(least, most))]
        return " ".join(" ".join(words[k : k + 11]) + "." * stops for k in range(0, len(words), 11))

    def own(least, most, stops=True):
        wanted.append(say(least, most, stops))
        return wanted[-1]

    menu = "<ul>" + "".join(f'<li><a href="/{k}">{say(1, 2, False)}</a></li>' for k in range(5)) + "</ul>"
    body = f"<h1>{own(3, 9, False)}</h1>"
    for k in range(rng.randint(3, 9)):
        body += f"<p>{own(15, 60)}</p>"
        if k == 1:
            body += "<ul>" + "".join(f"<li>{own(3, 15, False)}</li>" for _ in range(3)) + "</ul>"
    article = f'<div class="{container}">{body}</div>'
    said = [say(6, 25) for _ in range(3)]
    if kind == 0:
        return f'<body><div class="crumb"><a href="/">{say(1, 1, False)}</a> / <a href="/x">{say(1, 2, False)}</a></div>{article}<div class="{comments}">' + "".join(f"<p>{x}</p>" for x in said) + f'</div><div class="colo">{say(4, 12)}</div>', wanted
    if kind == 1:
        talk = "".join(f'<div class="{comments}-x"><p>{say(1, 3, False)}</p><p>{x}</p></div>' for x in said)
        return f'<body><div id="zone"><h2>{say(1, 3, False)}</h2>{menu}</div><div class="wa"><div class="wb">{article}<div class="{comments}">{talk}</div></div><div class="rr"><h3>{say(1, 3, False)}</h3>{menu}</div></div><div class="btm"><p>{say(4, 12)}</p></div>', wanted
    if kind == 2:
        return f'<body><table><tr><td class="l">{menu}</td><td class="{container}">{body}</td></tr></table><div class="msg">{say(6, 20)}</div><form><label>{say(1, 2, False)}</label></form>', wanted
    rest = "".join(f"<div><h5><a href=x>{say(3, 8, False)}</a></h5><p>{say(6, 16)}</p></div>" for _ in range(3))
    return f'<body><div class="ck"><p>{say(8, 25)}</p><button>ok</button></div>{article}<div class="{comments}"><h3>{say(1, 2, False)}</h3><ul>' + "".join(f"<li>{x}</li>" for x in said) + f'</ul></div><div class="oth"><h4>{say(1, 2, False)}</h4>{rest}</div>', wanted


@data
def test_layouts_whose_names_were_never_seen(spark, labeller):
    rng = random.Random(8)
    right = n = whole = 0
    for k in range(200):
        html_text, wanted = strange_page(rng, rng.choice(("entry-zz", "qx", "unit", "c17", "lay")), rng.choice(("vox", "uu", "tlk", "mm")), k % 4)
        page = html_extract.read(html_text)
        kept = labeller.probabilities([html_extract.Inputs(page, html_extract.measures(page.texts))])[0] >= 0.5
        good = [(t in wanted) == q for t, q in zip(page.texts, kept, strict=True)]
        right, n, whole = right + sum(good), n + len(good), whole + all(good)
    print(f"blocks {right / n:.4f}, whole pages {whole / 200:.3f}")
    assert right / n > 0.95 and whole / 200 > 0.6


STORY = """<html><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><article class="story"><h1>A title of some words</h1><p>{0}</p>{1}<p>{0}</p></article>
<footer>Copyright 2020 the site</footer></body></html>"""
SAID = "The quick brown fox jumped over the lazy dog while the river went on, and nobody minded. " * 2
OF_THE_ARTICLE = (
    "<table><tr><th>Year</th><th>Sales</th></tr>" + "".join(f"<tr><td>{1990 + k}</td><td>{k * 137}</td></tr>" for k in range(5)) + "</table>",
    "<dl><dt>Term one</dt><dd>The meaning of the term, in words.</dd><dt>Two</dt><dd>Other meaning</dd></dl>",
    "<figure><img src=x><figcaption>A view of the town in spring</figcaption></figure>",
    "<ul><li><a href=1>First link of the story</a></li><li><a href=2>Second link</a></li></ul>",
)
NOT_OF_IT = (
    '<div class="comments"><p>I think that this is a great article, thanks for writing it.</p><p>Nice one!</p></div>', '<div class="ad">Buy now the best of shoes for you</div>',
    '<div class="related"><h3>Related</h3><ul><li><a href=3>Another story here</a></li></ul></div>', '<ul class="menu"><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>',
)


@data
@pytest.mark.parametrize(("part", "stays"), [(p, True) for p in OF_THE_ARTICLE] + [(p, False) for p in NOT_OF_IT])
def test_parts_inside_an_article(spark, labeller, part, stays):
    table = spark.createDataFrame([(1, STORY.format(SAID, part))], "page_id long, html string")
    own = [b[1] for b in html_extract.blocks(part)]
    assert html_extract.main_text(table, labeller).first()["text"].split("\n") == ["A title of some words", SAID.strip(), *(own if stays else ()), SAID.strip()]


def test_the_network_equals_a_plain_forward_pass():
    """Both directions step by step, one page at a time, with gates written out."""
    rng, net = np.random.default_rng(4), html_extract.BiLSTM()
    pages = [html_extract.read("".join(f"<{t}>{' '.join(['w'] * int(rng.integers(1, 40)))}</{t}>" for t in rng.choice(["p", "li", "h2", "td"], n))) for n in (1, 5, 17)]
    given = [html_extract.Inputs(p, html_extract.measures(p.texts)) for p in pages]
    logistic = lambda a: 1 / (1 + np.exp(-a.astype(np.float64)))
    size = html_extract.HIDDEN
    for own, found in zip(given, net.probabilities(given), strict=True):
        x, total = own.rows(0, len(own)), np.zeros(len(own))
        for side in (0, 1):
            h = c = np.zeros(size)
            for t in range(len(x)) if side == 0 else reversed(range(len(x))):
                a = x[t] @ net.params["in"][side] + net.params["bias"][side, 0] + h @ net.params["rec"][side]
                i, f, o, g = logistic(a[:size]), logistic(a[size : 2 * size]), logistic(a[2 * size : 3 * size]), np.tanh(a[3 * size :])
                c = f * c + i * g
                h = o * np.tanh(c)
                total[t] += (h @ net.params["out"][side])[0]
        assert np.allclose(found, logistic(total + net.params["out_bias"][0]), atol=1e-5)


def test_pages_that_name_no_part(spark):
    """Without an example to learn from the network still judges: nothing is kept for want of a labeller."""
    rng = random.Random(3)
    pages = [(k, *strange_page(rng, "aa", "bb", 3)) for k in range(12)]
    table = spark.createDataFrame([(k, h) for k, h, _ in pages], "page_id long, html string")
    net = html_extract.fit(table)
    right = n = 0
    for r in html_extract.main_text(table, net).collect():
        kept, wanted = r["text"].split("\n"), pages[r["page_id"]][2]
        good = [(t in kept) == (t in wanted) for t in html_extract.read(pages[r["page_id"]][1]).texts]
        right, n = right + sum(good), n + len(good)
    assert right / n > 0.85
    menu = spark.createDataFrame([(1, '<ul><li><a href="/">Home</a><li><a href="/a">About</a></ul><p>Real words of the story here, and more of them.</p>')], "page_id long, html string")
    assert html_extract.main_text(menu, net).head()["text"] == "Real words of the story here, and more of them."
    assert isinstance(html_extract.fit(table.limit(0)), html_extract.BiLSTM)


def test_probabilities_of_long_pages_and_short_ones():
    net = html_extract.BiLSTM()
    pages = [html_extract.read("<p>word words</p>" * n) for n in (0, 1, 3, 9_000, 2)]
    inputs = [html_extract.Inputs(p, html_extract.measures(p.texts)) for p in pages]
    together = net.probabilities(inputs)
    assert [len(p) for p in together] == [0, 1, 3, 9_000, 2]
    assert all(np.allclose(net.probabilities([x])[0], p, atol=1e-5) for x, p in zip(inputs, together, strict=True))


@data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tests.llm.test_groups import brute_components, brute_fingerprint
    from tests.llm.test_rows import brute_hits, brute_rules

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        m = brute_rules(r["text"])
        if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
            assert r["doc_id"] not in ids
    kept = stages["language ID"](spark, kept, SF)
    assert kept.columns == docs.columns and kept.count() > 0.95 * len(ids)
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    one = stages["SimHash near-dedup"](spark, spark.createDataFrame(rows, kept.schema), SF).collect()
    roots = brute_components(np.array([brute_fingerprint(r["text"]) for r in rows], np.uint64))
    assert sorted(r["doc_id"] for r in one) == sorted({rows[k]["doc_id"] for k in roots})
    clean = stages["benchmark decontamination"](spark, spark.createDataFrame(one, kept.schema), SF).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in one[::9]:
        n, hit, *_ = brute_hits(r["text"], items)
        assert (r in clean) == (not (hit > 0 and 20 * hit >= n))
    mixed = stages["mixing"](spark, spark.createDataFrame(clean, kept.schema), SF)
    assert mixed.count() == len(clean) and set(mixed.columns) == {"doc_id", "size", "source_size", "target", "taken"}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
