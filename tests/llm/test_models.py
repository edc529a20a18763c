import math
import random
import re
import zlib

import numpy as np
import pytest

from tideline.llm import html_extract as h
from tideline.llm import langid
from tideline.llm.html_pages import labelled_pages

LANGS = {"xx": "ka lo mi nu pe ra so".split(), "yy": "the ing ed er st wh".split(), "zz": "über schö ße ich äng".split()}


def language_rows(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        words = ["".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words) + " 123 ###", lang if r.random() < 0.9 else None, "s"))
    return rows, None


def test_held_out_accuracy(docs):
    rows, _ = language_rows(400)
    got = {r["doc_id"]: r for r in langid.identify(docs(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    known = [r for r in held if r[2]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in known) >= 0.97 * len(known)
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_labels_of_held_out_rows_are_never_used(docs):
    rows, _ = language_rows(200)
    swapped = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 3 == 1 else la, s) for i, t, la, s in rows]
    a, b = ({tuple(r) for r in langid.identify(docs(x)).collect()} for x in (rows, swapped))
    assert a == b


def test_language_edges(docs, edges, empty):
    got = {r["doc_id"]: r for r in langid.identify(edges).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[7]["lang_pred"] in ("en", "de")
    assert langid.identify(empty).count() == 0
    untaught = langid.identify(docs([(1, "words here", None)]))
    assert [(r["lang_pred"], r["score"]) for r in untaught.collect()] == [("und", 0.0)]
    assert langid.identify(docs([(3, "1234 !?", "en"), (4, "words", "en"), (5, "more", "en")])).where("doc_id = 3").first()["lang_pred"] == "und"


@pytest.mark.parametrize("piece", [1, 2, 3, 64, 1000])
def test_counts_do_not_depend_on_pieces(monkeypatch, piece):
    for text in ("Grüße an alle, 12 Bäume   stehen  im Wald. " * 40, "", " ", "a", "12", "ab  c", "1a", "ΑΣ ΟΔΟΣ 日本"):
        one, many = np.zeros(1 << langid.BITS, np.int64), np.zeros(1 << langid.BITS, np.int64)
        letters = langid.counts_of(text, one)
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", piece)
            assert langid.counts_of(text, many) == letters and (one == many).all()
        words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        grams = max(0, len(f" {words} ")) if words else 1
        assert one.sum() == sum(max(0, grams - n + 1) for n in langid.GRAMS)


def plain_ftrl(rows, n_docs, df):
    """The training by dicts and loops, coordinate by coordinate."""
    langs = sorted({lang for lang, _, _ in rows})
    idf = lambda f: math.log((1 + n_docs) / (1 + df[f])) + 1
    data = []
    for lang, at, n in rows:
        x = {int(f): (1 + math.log(c)) * idf(int(f)) for f, c in zip(at, n, strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        data.append((langs.index(lang), {**{f: v / norm for f, v in x.items()}, "bias": 1.0}))
    z, g2 = {}, {}

    def weight(f, k):
        v = z.get((f, k), 0.0)
        if abs(v) <= langid.L1:
            return 0.0
        return -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(g2.get((f, k), 0.0))) / langid.ALPHA + langid.L2)

    used = [d for i, d in enumerate(data) if i % 10 or len(data) < 50]
    for _ in range(langid.EPOCHS):
        for y, x in used:
            w = {(f, k): weight(f, k) for f in x for k in range(len(langs))}
            s = [sum(v * w[f, k] for f, v in x.items()) for k in range(len(langs))]
            e = [math.exp(v - max(s)) for v in s]
            for f, v in x.items():
                for k in range(len(langs)):
                    g = v * (e[k] / sum(e) - (k == y))
                    before = g2.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA * w[f, k]
                    g2[f, k] = before + g * g
    return langs, weight


def test_training_matches_a_plain_version():
    rows, df = [], np.zeros(1 << langid.BITS)
    for _, text, lang, _ in language_rows(70, 5)[0]:
        if lang:
            at, n = langid.sparse(text)
            rows.append((lang, at, n))
            df[at] += 1
    model = langid.fit(rows, len(rows), df)
    langs, weight = plain_ftrl(rows, len(rows), df)
    assert model.langs == langs
    features = sorted({int(f) for _, at, _ in rows for f in at})
    for k in range(len(langs)):
        assert model.bias[k] == pytest.approx(weight("bias", k), abs=1e-9)
        assert all(model.weights[f, k] == pytest.approx(weight(f, k), abs=1e-9) for f in features)
    unseen = np.setdiff1d(np.arange(1 << langid.BITS), features)
    assert not model.weights[unseen].any() and (model.weights[features] == 0).any()
    losses = {}
    for t in (model.temperature, 0.5 * model.temperature, 2 * model.temperature):
        spared = [(langs.index(lang), model.logits(at, n)) for lang, at, n in rows[::10]]
        losses[t] = -sum(math.log(max(1e-12, langid.softmax(z / t)[y])) for y, z in spared)
    assert min(losses, key=losses.get) == model.temperature


@pytest.fixture(scope="module")
def model():
    return h.default_model()


def test_blocks_of_unseen_pages(model):
    right = total = 0
    for page in labelled_pages(150, 4242):
        nodes, _ = h.blocks_of(page)
        tree = h.Tree(nodes, *model)
        tree.run()
        for k, (b, y) in enumerate(zip(nodes, h.truth(nodes), strict=True)):
            if sum(b.text):
                total += 1
                right += (tree.marginal[k] > 0.5) == bool(y)
    assert right >= 0.97 * total


def test_marginals_are_exact():
    """Message passing against the sum over all states."""
    import itertools
    import math

    page = "<body><div class=x>some text<p>more <b>text</b></p></div><ul><li>a<li>b</ul></body>"
    nodes, _ = h.blocks_of(page)
    r = random.Random(1)
    weights = {f: r.uniform(-1, 1) for k, b in enumerate(nodes) for f in h.features(b, nodes[b.parent] if k else None)}
    pairs = {key: [r.uniform(-1, 1) for _ in range(4)] for b in nodes[1:] for key in h.pair_keys(b, nodes[b.parent])}
    tree = h.Tree(nodes, weights, pairs)
    tree.run()
    n, z, one = len(nodes), 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=n):
        s = sum(tree.unary[k] * states[k] for k in range(n)) + sum(tree.pair[k][2 * states[nodes[k].parent] + states[k]] for k in range(1, n))
        w = math.exp(s)
        z += w
        for k in range(n):
            one[k] += w * states[k]
    assert all(abs(tree.marginal[k] - one[k] / z) < 1e-9 for k in range(n))


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- note <p>hidden</p> --><div class="cookie-banner">We use cookies.</div>
<article><h1>The title &amp; more</h1><p>First   paragraph with <b>bold</b> te<i>xt</i>&nbsp;here, long enough to be read as prose.
<p>Second one &eacute; &#233; &lt;tag&gt;.<br>After a break.</p><div class="ad">Buy now</div><ul><li>point one of the list</li><li>point two of the list</li></ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this article.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside><form><label>Search</label><input><button>Go</button></form>
<footer>&copy; 2020 Site</footer></body></html>"""
TEXT = "The title & more First paragraph with bold text here, long enough to be read as prose. Second one é é <tag>. After a break. point one of the list point two of the list"


#: Pages written by hand, with their main text: an encyclopedia, a table layout, a newspaper, a blog.
PAGES = {
"wiki": ("""<!DOCTYPE html><html class="client-nojs"><head><meta charset="utf-8"><title>Lighthouse - Encyclopedia</title><link rel=stylesheet href=/w.css></head><body class="skin-vector ns-0">
<div id="mw-head"><div id="p-personal"><ul><li><a href="/login">Log in</a></li><li><a href="/signup">Create account</a></li></ul></div></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading">Lighthouse</h1>
<div id="bodyContent"><p>A <b>lighthouse</b> is a tower designed to emit light from a system of lamps and lenses, and to serve as a beacon for <a href="/wiki/Pilotage">navigational</a> aid for maritime pilots at sea.</p>
<h2>History</h2><p>Before the development of clearly defined ports, mariners were guided by fires built on hilltops. Placing the fire on a platform improved its visibility.</p>
<ul><li>The Pharos of Alexandria stood for more than a thousand years.</li><li>The Tower of Hercules is still in use today on the coast of Spain.</li></ul></div></div>
<div id="mw-navigation"><div id="p-navigation" role="navigation"><h3>Navigation</h3><ul><li><a href="/">Main page</a></li><li><a href="/r">Random article</a></li></ul></div></div>
<div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 March 2020.</li><li><a href="/privacy">Privacy policy</a></li></ul></div></body></html>""",
"Lighthouse A lighthouse is a tower designed to emit light from a system of lamps and lenses, and to serve as a beacon for navigational aid for maritime pilots at sea. History Before the development of clearly defined ports, mariners were guided by fires built on hilltops. Placing the fire on a platform improved its visibility. The Pharos of Alexandria stood for more than a thousand years. The Tower of Hercules is still in use today on the coast of Spain."),
"table": ("""<html><head><title>My garden</title></head><body bgcolor=white><table width=100% cellpadding=4><tr><td colspan=2 class=header><h1>Green thumb site</h1></td></tr>
<tr><td valign=top class=menu><a href=a.html>Home</a><br><a href=b.html>Roses</a><br><a href=c.html>Tools</a></td>
<td valign=top class=content><h2>Growing tomatoes in pots</h2><p>Tomatoes need a pot of at least ten litres, good soil and six hours of sun every day. Water them in the morning &amp; never on the leaves.
<p>Pinch out the side shoots once a week, and tie the main stem to a stick so that the wind does not break it.</td></tr>
<tr><td colspan=2 class=footer>Copyright 2003 by the garden club. <a href=mail.html>Contact</a></td></tr></table></body></html>""",
"Growing tomatoes in pots Tomatoes need a pot of at least ten litres, good soil and six hours of sun every day. Water them in the morning & never on the leaves. Pinch out the side shoots once a week, and tie the main stem to a stick so that the wind does not break it."),
"news": ("""<html lang=de><head><title>Zeitung</title><script async src=//cdn.example.com/>var leaked = 1;</script></head><body><div class="c-page"><div class="c-header__navigation"><ul class="c-nav"><li class="c-nav__item"><a href="/politik">Politik</a></li><li class="c-nav__item"><a href="/sport">Sport</a></li></ul></div>
<div class="c-article"><div class="c-article__header"><h1 class="c-article__title">Neue Brücke über den Fluss eröffnet</h1></div><div class="c-article__body"><p class="c-article__text">Nach drei Jahren Bauzeit ist am Montag die neue Brücke für den Verkehr freigegeben worden. Hunderte Bürger kamen zur Feier.</p>
<div class="c-anzeige werbung">Anzeige: Jetzt günstig Strom wechseln und hundert Euro sparen!</div>
<p class="c-article__text">Der Bürgermeister sprach von einem guten Tag für die Stadt, die lange auf diesen Moment gewartet habe.</p></div></div>
<div class="c-kommentare kommentare"><h3>Kommentare</h3><div class="kommentar"><p>Endlich fertig, das hat ja auch wirklich lange genug gedauert.</p></div></div>
<div class="c-footer fusszeile"><a href="/impressum">Impressum</a> <a href="/agb">AGB</a></div></div></body></html>""",
"Neue Brücke über den Fluss eröffnet Nach drei Jahren Bauzeit ist am Montag die neue Brücke für den Verkehr freigegeben worden. Hunderte Bürger kamen zur Feier. Der Bürgermeister sprach von einem guten Tag für die Stadt, die lange auf diesen Moment gewartet habe."),
"blog": ("""<!doctype html><html><head><title>x</title></head><body><div id="wrapper"><div id="header"><h1><a href="/">Notes from the attic</a></h1><p class="tagline">A blog about old radios</p></div>
<div id="cookie-notice">This site uses cookies to improve your experience. <a href="/c">Learn more</a> <button>OK</button></div>
<div class="post hentry"><h2 class="entry-title">Repairing a valve amplifier</h2><div class="entry-content"><p>The amplifier came from a flea market and hummed loudly, so I replaced both filter capacitors first.</p><pre>R1 = 47k
C1 = 32 uF</pre><blockquote>Never work on a powered chassis with two hands.</blockquote><video src=a.webm>A short film of the glowing valves.</video><p>After that the hum was gone.</p></div>
<div class="sharing"><ul><li><a href="/t">Share</a></li><li><a href="/m">Mail</a></li></ul></div></div>
<div id="comments" class="comments-area"><h3>2 responses</h3><ol class="commentlist"><li class="comment"><p>Great work, I had the same trouble with mine last year.</p></li><li class="comment"><p>Which capacitors did you use for this?</p></li></ol><form id="respond"><label>Your comment</label><textarea>type here</textarea></form></div>
<div id="sidebar"><div class="widget"><h3>Archives</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div></div><div id="footer">Powered by an old server</div></div></body></html>""",
"Repairing a valve amplifier The amplifier came from a flea market and hummed loudly, so I replaced both filter capacitors first. R1 = 47k C1 = 32 uF Never work on a powered chassis with two hands. A short film of the glowing valves. After that the hum was gone."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_that_no_grammar_made(model, name):
    page, text = PAGES[name]
    assert h.main_text(page, model) == text


def test_raw_elements_and_fallbacks(model):
    page, text = PAGES["blog"]
    put = lambda extra: h.main_text(page.replace("<pre>", extra + "<pre>"), model)
    before, after = text.split(" R1 = ")
    with_it = lambda words: f"{before} {words} R1 = {after}"
    assert put('<script src=//cdn.example.com/>var leaked = 1;</script>') == text == put('<script src="a.js"/>var leaked;</script>') == put("<style/>p{}</style>")
    assert put("<svg class=icon/>drawn</svg>") == text == put('<svg width="1"><text>drawn</text></svg>')
    assert put('<p>shown <svg width="1"/>here, in a sentence long enough to be prose.</p>') == with_it("shown here, in a sentence long enough to be prose.")
    for tag in ("object", "audio", "canvas", "noscript", "template"):
        assert put(f"<p>A sentence that goes on <{tag}>with a fallback</{tag}> and then ends in a dot.</p>") == with_it("A sentence that goes on with a fallback and then ends in a dot.")
    assert put("<p>A sentence that goes on with <xmp>x < y &amp; z</xmp> and then ends in a dot.</p>") == with_it("A sentence that goes on with x < y &amp; z and then ends in a dot.")


def test_page(spark):
    pages = spark.createDataFrame([(1, "u1", SITE, 0), (2, None, None, 0), (3, "u3", "", 0), (3, "u3", "<p>a < b", 0), (4, "u", SITE.replace("</body></html>", "")[:-30], 0), (5, "u5", "<" * 3000 + "<p " * 2000, 0)], "page_id long, url string, html string, text int")
    rows = h.extract(pages).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 6 and got[1]["text"] == TEXT == got[4]["text"] and got[1]["n_chars"] == len(TEXT)
    assert got[2]["text"] == "" and got[2]["url"] is None
    assert h.extract(pages.where("page_id < 0")).count() == 0


def test_generated_pages_of_the_test_tables(spark, sf_dir):
    """The article element of these pages, by a plain pattern."""
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in h.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        article = re.sub(r"</?b>", "", article)
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


@pytest.mark.parametrize("attribute", ['data-y="12.5"', "data-y", 'data-year="2020"', "data-yoast=on", 'data-y="1"', 'data-y="0"', 'classy="nav"', 'hidden-by="x"'])
def test_label_attributes_mean_nothing_on_pages(model, attribute):
    pages = [re.sub(' data-y="[01]"', "{}", p) for p in labelled_pages(20, 4242) if "{" not in p]
    plain = [h.main_text(p.replace("{}", ""), model) for p in pages]
    assert [h.main_text(p.replace("{}", " " + attribute), model) for p in pages] == plain and any(plain)


def test_formulas_stay_in_the_text(model):
    formula = "so <math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/></mrow></math> holds, "
    pages = [p for p in labelled_pages(40, 4242) if '<p data-y="1">' in p]
    with_formula = [h.main_text(p.replace('<p data-y="1">', '<p data-y="1">' + formula), model) for p in pages]
    in_words = [h.main_text(p.replace('<p data-y="1">', '<p data-y="1">so x=12 holds, '), model) for p in pages]
    assert with_formula == in_words and any("so x=12 holds, " in t for t in in_words)
