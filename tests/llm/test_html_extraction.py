"""Blocks of pages, the labeller against plain loops and finite differences, and what it extracts from pages it hasn't seen."""

import html
import re

import numpy as np
import pytest

from sparkseek.llm import html_extraction, queries
from sparkseek.llm.html_blocks import CUE, CUES, NEAR, TAGS, Block, blocks
from sparkseek.llm.html_extraction import HIDDEN, Direction, extract_main_text, inputs, learn, scores, train_labeller, training_pages, unpacked
from sparkseek.llm.html_pages import Maker, read_labels

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return train_labeller(spark.read.parquet(f"{DATA}/pages.parquet"), max_pages=100)


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p>a<b>b<p>c &amp; d<ul><li>x<li>y<a href='q'>l</a></ul>t", ["ab", "c & d", "x", "yl", "t"]),
        ("<DIV>a\n\t b&nbsp;&#x41;<BR>c</DIV>", ["a b A c"]),
        ("<script>var a = '<p>no</p>'</script>r<style>p{}</style><!-- <p>no</p> -->s<title>no</title>", ["rs"]),
        ("x<script>never ends <p>no</p>", ["x"]),
        ("x<!-- never ends <p>no</p>", ["x"]),
        ("x<p class='y", ["x"]),
        ('<p title="a > b">x</p><p title=\'"\'>y</p>', ["x", "y"]),
        ("<b><article>q</b> w</article>z", ["q w", "z"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a < b > c &lt;p&gt; &bogus; &#0;", ["a < b > c <p> &bogus; �"]),
        ("<svg><text>no</text></svg><svg/>x", ["x"]),
        ("<>1</>2<?php 3 ?>4</nothing>5", ["<>124", "5"]),
        (None, []), ("", []), (" \n ", []), ("<p></p>", []), ("plain", ["plain"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths_and_links():
    page = '<div id="siteFooter"><nav><a href=x>one</a> two</nav></div><section class="user comments"><p>x</p></section>y'
    one, x, y = blocks(page)
    cue = {name: CUE + k for k, name in enumerate(CUES)}
    near = {name: NEAR + k for k, name in enumerate(CUES)}
    assert {TAGS.index("div"), TAGS.index("nav"), cue["footer"], near["footer"], cue["layout"]} <= one.places and one.linked == 3
    assert {TAGS.index("section"), TAGS.index("p"), cue["comments"], near["comments"]} <= x.places and TAGS.index("nav") not in x.places
    assert y.places == frozenset()


def test_deep_and_damaged_pages_take_linear_time():
    for bad in ("<div>" * 50_000 + "x" + "</i>" * 50_000, '<a "' * 50_000, '<a ">" ' * 50_000, "<!--" * 50_000, "<b>" * 50_000 + "<p>x" * 500, "<p><span>" * 50_000):
        assert len(blocks(bad)) <= 500


def plain_scores(model, page):
    """One page, one block, one gate after another."""
    x, n = inputs(page), len(page)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    logit = np.full(n, float(model.out[-1]))
    for net, out, order in ((model.forward, model.out[:HIDDEN], range(n)), (model.backward, model.out[HIDDEN:-1], reversed(range(n)))):
        h = c = np.zeros(HIDDEN)
        for k in order:
            z = x[k] @ net.inputs + h @ net.states + net.bias
            i, f, o, a = (z[g * HIDDEN : (g + 1) * HIDDEN] for g in range(4))
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(a)
            h = sigmoid(o) * np.tanh(c)
            logit[k] += h @ out
    return sigmoid(logit)


def some_pages(n, seed=5):
    maker = Maker(seed, ["Some words of a longer text. " * 4, "One two three, four."], ["menu", "about us"])
    return [read_labels(maker.page()) for _ in range(n)]


def test_scores_against_a_plain_loop(model, monkeypatch):
    pages = [found for found, _ in some_pages(12)]
    pages[3:3] = [[], [Block("alone", 0, frozenset())]]
    plain = [plain_scores(model, page) for page in pages]
    for window in (1 << 15, 7):
        monkeypatch.setattr(html_extraction, "_WINDOW", window)
        for a, b in zip(scores(model, pages), plain, strict=True):
            assert np.allclose(a, b, atol=1e-4)
    assert [x.tolist() for x in scores(model, [[], []])] == [[], []]


def test_gradients_against_finite_differences():
    random = np.random.default_rng(2)
    active = np.array([3, 3, 2, 1])
    x = random.normal(size=(9, 5)).astype(np.float64)
    net = Direction(random.normal(size=(5, 4 * HIDDEN)), random.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.3, random.normal(size=4 * HIDDEN))
    slope = random.normal(size=(9, HIDDEN))
    loss = lambda net: float((html_extraction._pass(net, x, active)[0].astype(np.float64) * slope).sum())
    grads = html_extraction._back(net, x, active, html_extraction._pass(net, x, active)[1], slope)
    for part in range(3):
        for _ in range(6):
            at = tuple(int(random.integers(s)) for s in net[part].shape)
            shifted = []
            for step in (1e-2, -1e-2):
                copy = [w.copy() for w in net]
                copy[part][at] += step
                shifted.append(loss(Direction(*copy)))
            assert abs((shifted[0] - shifted[1]) / 2e-2 - grads[part][at]) < 2e-2 * max(1, abs(grads[part][at]))


def test_training_repeats_and_learns():
    pages = some_pages(60)
    one, two = learn(pages, epochs=2), learn(pages, epochs=2)
    assert one.packed() == two.packed() == unpacked(one.packed()).packed()
    taught = learn(some_pages(400), epochs=6)
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(scores(taught, [found for found, _ in some_pages(100, 77)]), some_pages(100, 77), strict=True)])
    assert right.mean() > 0.97
    assert len(training_pages([], 3)) == 3 and learn([]).packed()


def plain_article(page):
    """The articles of these pages by their known layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"<p>|</p>|</h1>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_the_query_against_the_pages_layout(spark):
    got = {r["page_id"]: r for r in queries.op12_main_text(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]]["text"] == plain_article(r["html"]) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_chars"] == len(plain_article(r["html"]))


PAGE = """<html><head><title>T</title></head><body class="home"><div id="cookie-banner"><p>This site uses cookies. <a href=#>OK</a></p></div>
<header class="site-header"><a href="/">My site</a><nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav></header>
<div class="container"><main><article class="post"><h1>Title of it</h1><p>Para one is here and it is long enough to be real text.</p>
<div class="share-buttons"><a>Tweet</a> <a>Share</a></div><p>Short.</p><ul><li>Item one</li><li>Item two</li></ul>
<div class="advertisement">Buy this now, very cheap, today only, in all stores near you.</div><p>Para three ends the
story &amp; all.</p></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>I think that this is a wonderful article and I have read it twice.</p>
</div></section></main><aside class="sidebar"><h3>Popular</h3><ul><li><a>Other story about things</a></ul><p>A paragraph in the sidebar that is rather long.</p></aside>
</div><form action="/s"><label>Mail</label><input><button>Subscribe</button></form><footer><p>&copy; 2024 My site. All rights reserved.</p></footer></body></html>"""
TEXT = "Title of it\n\nPara one is here and it is long enough to be real text.\n\nShort.\n\nItem one\n\nItem two\n\nPara three ends the story & all."


def test_a_page_of_another_layout(spark, model):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "<script>x</script>"), (None, "<nav><a>Home</a></nav>"), (5, "<p>" + "A long text without a frame goes on. " * 50_000 + "</p>")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, html string, Main_Text string")
    assert extract_main_text(df, model).columns == ["page_id", "html", "Main_Text", "main_text_"]
    got = extract_main_text(df, model, keep=["page_id", "Main_Text"]).collect()
    assert {r["Main_Text"] for r in got} == {"kept"}
    found = sorted((r["page_id"] or 0, r["main_text_"]) for r in got)
    assert found[:6] == [(0, ""), (1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "")]
    assert found[6][1] in ("", ("A long text without a frame goes on. " * 50_000).strip())  # whole or not at all
    assert extract_main_text(df.limit(0), model).count() == 0
    assert train_labeller(df.limit(0).drop("Main_Text"), made=9).packed() == train_labeller(df.where("page_id = 2").drop("Main_Text"), made=9).packed()


def test_made_pages_that_were_not_trained_on(spark, model):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    made = training_pages(pages[-40:], 300, seed=991)[-300:]
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(scores(model, [found for found, _ in made]), made, strict=True)])
    assert right.mean() > 0.99
