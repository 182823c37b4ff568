"""Main text of hand-written pages in layouts of their own, and of markup that is meant to hurt."""

import time

import pytest

from almanac.llm import html_text

A, B, C = "The old river ran slowly past the mill, and the children watched it from the bridge.", "Nobody had seen the ferry that year; the keeper said it was waiting for spring.", "In the evening the lamps were lit, one after the other, along the water."


@pytest.fixture(scope="module")
def model():
    return html_text.train(html_text.labelled_pages())


LAYOUTS = {
    "names that say nothing": (f'<html><body><div class="x1"><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><div class="x2"><p>{A} {B} {C} {A} {B} {C} {A} {B}</p></div><div class="x3"><a href=q>About</a></div></body></html>', [f"{A} {B} {C} {A} {B} {C} {A} {B}"]),
    "bare text": (f"{A} {B}", [f"{A} {B}"]),
    "text in the body": (f"<body>{A}</body>", [A]),
    "paragraphs in the body": (f"<html><body><h1>On rivers</h1><p>{A}<p>{B}<p>{C}</body></html>", ["On rivers", A, B, C]),
    "own names in an article": (f'<body><nav><a href="/">Home</a></nav><article><h1>On rivers</h1><p>{A}</p><p class="more">{B}</p><p class="related">{C}</p></article><footer>Foot</footer></body>', ["On rivers", A, B, C]),
    "formula and drawing": (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold. {A}</p><p>{B} <svg><text>label</text></svg></p></article>", [f"Let x=1 hold. {A}", f"{B} label"]),
    "cut references": (f"<article><p>{A} AT&am<b>p;</b>T &amp; &eacute;&#33;</p><p>{B}</p></article>", [f"{A} AT&amp;T & é!", B]),
    "surroundings inside": (f'<body><header><h1>Site</h1></header><main><article><h2>On rivers</h2><p>{A}</p><aside><h3>See also</h3><ul><li><a href=x>That</a></li></ul></aside><p>{B}</p></article></main><section id="comments"><p>{C}</p></section></body>', ["On rivers", A, B]),
    "table layout": (f'<table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table>', [A, B, C]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(model, name):
    page, want = LAYOUTS[name]
    assert model.text(page).split("\n") == want


@pytest.mark.parametrize("bad", ["<a ", '<a b="', "<a b='x>", "<script>", "</script", "<!--", "<![CDATA[", "<div>", "<p>", "</div>", "< ", "<!x", "&#", "<ul><li>", '<a ="', "<x y=>"])
def test_hostile_markup_is_linear(bad):
    """A megabyte of each, without an end and with one; most take a few tenths of a second."""
    for tail in ("", ">", '">'):
        began = time.process_time()
        html_text.parse(bad * (300_000 // len(bad)) + tail)
        assert time.process_time() - began < 5


def test_markup_rules():
    blocks = lambda page: [t for _, t in html_text.parse(page)[1]]
    assert blocks('<p title="a > b">x</p>') == ["x"] and blocks("<p title='a > b' id=c/d>x</p>") == ["x"]
    assert blocks("a < b <c") == ["a < b <c"] and blocks("1 <2> 3 </ > 4") == ["1 <2> 3 4"]
    assert blocks("<script>var a='</p>'</script >after<style>p{}</style>") == ["after"]
    assert blocks("<![CDATA[a &amp; b]]> c &amp; d") == ["a &amp; b c & d"]
    assert blocks('<p a="b>x</p>') == ["x"] and blocks("x<br>y<!-- <p> -->z") == ["x yz"]
    assert blocks("a" * 500_000 + "<p>" + "b " * 200_000)[0] == "a" * 500_000
    assert blocks("") == [] and blocks("<div></div>") == []


def test_empty_table_and_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, "old", 3), (1, None, None, "old", 3), (None, "u", f"<article><p>{A}</p></article>" + " " * 100_000, None, None)]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, A, len(A)), (1, "", 0), (1, "", 0)]
