import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarry.llm.html_text import Field, blocks, default_field, extract, features, labelled_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><!-- <p>hidden</p> -->
<article><h1>The   title</h1><p>First <b>bold</b> &amp; caf&eacute; &#8212; x &unknown; y.<p>Second<br>line.
<ul><li>Point one<li>Point two</ul><table><tr><td>Cell<td>42</table><div class="ad">Buy now</div><p>Last words.</article>
<aside class="sidebar"><p>Related stories you may like</p></aside><section id="comments"><p>I disagree, said a reader.</p></section>
<form action="/s"><label>Your name</label><button>Go</button></form><footer>&copy; 2024 Example &middot; All rights reserved.</footer></body></html>"""


def test_page():
    want = ["The title", "First bold & café — x &unknown; y.", "Second line.", "Point one", "Point two", "Cell", "42", "Last words."]
    assert extract(default_field(), [PAGE])[0].split("\n") == want


def test_parser_is_tolerant():
    assert [b.text for b in blocks("a<p>b<p>c</div>d<i>e</b>f")] == ["a", "b", "c", "def"]
    assert [b.text for b in blocks("<p>x <script>if (a < b) '</p>'</script> y")] == ["x y"]
    assert [b.text for b in blocks("<p>1 < 2 & 3 > 2 <")] == ["1 < 2 & 3 > 2 <"]
    assert blocks("<!-- never closed <p>x") == [] and blocks("<script>never closed") == []
    assert [b.text for b in blocks("<div title='a > b'>x</div>")] == ["x"]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert [b.text for b in blocks(deep)] == ["deep"]


def test_skipped_elements_without_end_tag():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("<html><head><title>t</title><meta charset=utf-8><style>p{}</style><body><p>x<p>y") == ["x", "y"]
    assert texts("<head><title>t</title><article><p>x</article>") == ["x"] and texts("<head><title>t</title>x<p>y") == ["x", "y"]
    assert texts("<head><title>t</title></head><p>x") == ["x"] and texts("<head><script>a</script><noscript>n</noscript></head>") == []
    for tag in "noscript template svg math iframe object select button canvas audio video".split():
        assert texts(f"<p>a<{tag} class=c><p>b</p><p>c") == ["a", "b", "c"]
        assert texts(f"<p>a<{tag}>no</{tag}> b<{tag}>c") == ["a bc"]
    assert texts("<p>a <svg/> b <math /> c</p><svg>no</svg>d") == ["a b c", "d"]
    for tag in "script style textarea title".split():
        assert texts(f"<p>a<{tag}><p>b") == ["a"]


def test_held_out_labels():
    field = default_field()
    pages = [p for p in map(blocks, labelled_pages(120, seed=77)) if p]
    state = field.viterbi(*field.scores(pages))
    pairs = [(bool(b.main), bool(s)) for p, row in zip(pages, state, strict=True) for b, s in zip(p, row, strict=False)]
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


#: Written by hand, in layouts that the training pages don't have; main blocks are marked with a leading *.
LAYOUTS = {
    "news": """<!doctype html><html><head><title>t</title></head><body><div id="topbar"><a href="/">The Daily Post</a></div>
<ul class="mainmenu nav"><li><a href=1>World</a></li><li><a href=2>Sport</a></li><li><a href=3>Money</a></li></ul>
<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/w">World</a></div>
<main><article class="story"><header><h1>*Harbour bridge to close for repairs</h1></header>
<p>*The old harbour bridge will close on Monday for six weeks while engineers replace two of its steel cables.</p>
<div class="ad-slot">Advertisement: save on car insurance today</div>
<p>*Drivers are asked to use the tunnel. <a href="/t">Traffic maps</a> will be published on Sunday evening, the city said.</p>
<h2>*What comes next</h2><p>*A second closure is planned for the spring.</p></article></main>
<aside class="related"><h3>Read more</h3><ul><li><a href=a>Ferry fares rise</a></li><li><a href=b>Ten walks near the sea</a></li></ul></aside>
<div id="newsletter-signup"><p>Get our newsletter every morning.</p><form><label>E-mail</label></form></div>
<footer><p>&copy; The Daily Post. All rights reserved.</p></footer></body></html>""",
    "blog": """<html><body><div class="header"><div class="logo"><a href="/">My garden</a></div></div>
<div class="nav"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div>
<div class="cookie-banner">This site uses cookies to remember your choices. <a href="/c">Accept</a></div>
<div class="post"><h2>*Tomatoes in a cold summer</h2><p>*I planted twelve tomatoes in May, and by July only four had flowers.</p><p>*The secret, an old neighbour told me, is to water them in the morning.</p>
<blockquote>*Never in the evening, never at noon.</blockquote><p>*We shall see.</p></div>
<div class="comments"><h4>2 comments</h4><div class="comment"><p>Same here, and I live much further south than you do!</p></div><div class="comment"><p>Try a smaller kind next year.</p></div></div>
<div class="sidebar"><h4>Archive</h4><ul><li><a href=1>June</a></li><li><a href=2>May</a></li></ul></div><div class="footer">Written with love. Copyright 2020 by me.</div></body></html>""",
    "manual": """<html><body><header><p>Tool docs</p></header><nav class="toc"><ol><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ol></nav>
<section class="content"><h1>*Install</h1><p>*Unpack the archive and run the installer.</p><pre>*make install</pre><table><tr><th>*Option</th><th>*Meaning</th></tr><tr><td>*-q</td><td>*Print nothing.</td></tr></table>
<ul><li>*The installer needs root rights.</li><li>*It leaves a log behind.</li></ul></section><footer><a href="/p">Privacy</a> &middot; <a href="/i">Imprint</a></footer></body></html>""",
    "capitals": """<HTML><BODY><DIV CLASS=MENU><A HREF=/>HOME</A></DIV><DIV ID=CONTENT><H1>*A letter from the coast</H1><P>*It has rained for nine days now, and the path to the light house is gone.
<P>*Still the boat comes, once a week, with bread and papers.</DIV><DIV CLASS=FOOTER>Copyright 1998</DIV></BODY></HTML>""",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_of_another_hand(name):
    marked = [b.text for b in blocks(LAYOUTS[name])]
    want = [t[1:] for t in marked if t.startswith("*")]
    got = extract(default_field(), [LAYOUTS[name].replace("*", "")])[0].split("\n")
    assert got == want


def test_the_slope_is_that_of_the_likelihood():
    pages = [p for p in map(blocks, labelled_pages(6, seed=3)) if p]
    field = Field(sorted({f for p in pages for b in p for f in features(b)}))
    rng = np.random.default_rng(1)
    for w in (field.emit, field.step, field.first):
        w += rng.normal(size=w.shape)
    given = field.encoded(pages)
    _, slopes = field.likelihood(*given)
    for w, g in zip((field.emit, field.step, field.first), slopes, strict=True):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(25)]:
            was = w[at]
            sides = []
            for d in (1e-5, -1e-5):
                w[at] = was + d
                sides.append(field.likelihood(*given)[0])
            w[at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
    best = min(field.likelihood(*given)[0], 0)
    assert best < 0 and np.isfinite(best)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_driver_pages():
    """All blocks of the article, and none of the rest, of every page."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    want = ["\n".join(b.text for b in blocks(p) if "article" in b.tags and "ad" not in b.hints) for p in pages]
    assert extract(default_field(), pages) == want


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(0)
    field = Field([])
    field.step, field.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    score, length = rng.normal(size=(5, 6, 2)), np.array([6, 1, 3, 5, 0])
    got = field.viterbi(score, length)
    for p, n in enumerate(length):
        def value(s):
            return sum(score[p, t, x] for t, x in enumerate(s)) + field.first[s[0]] + sum(field.step[a, b] for a, b in zip(s[:-1], s[1:], strict=True))  # noqa: B023

        if n:
            best = max((tuple(int(b) for b in np.binary_repr(k, n)) for k in range(1 << n)), key=value)
            assert tuple(got[p, :n]) == best


def test_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE), (3, "u", "<article>" + "<p>word " * 20000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = main_text(spark, df).collect()
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 2] == [""] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"].count("\n") for r in got if r["page_id"] == 3] == [19999]
    assert main_text(spark, df.where("false")).isEmpty()
