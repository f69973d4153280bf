"""Main-text extraction: pages of known article against text written by hand, odd pages, time."""

import time

import pytest

from textquarry.llm.html_extract import extract, html_extract

LONG = "Some long text here, with commas, and more words in it to be scored well enough by length and by commas."
P = f"<p>{LONG}</p><p>{LONG}</p>"

PAGES = {
    "a class that says there is a sidebar": (f'<div class="content has-sidebar"><h1>T</h1>{P}<div class="sidebar"><p>side, side</p></div></div>', ["T", LONG, LONG]),
    "a class that says there are no comments": (f'<div class="single-post no-comments"><h1>T</h1>{P}</div>', ["T", LONG, LONG]),
    "a layout named after its sidebar": (f'<div class="layout sidebar-left-page"><div>{P}</div></div>', [LONG, LONG]),
    "a title beside the entry": (f'<div><h1>T</h1><div class="entry">{P}</div></div>', ["T", LONG, LONG]),
    "a title in a container beside the entry": (f'<div class="post"><div class="entry-header"><h1>T</h1></div><div class="entry">{P}</div></div>', ["T", LONG, LONG]),
    "a title in the header of main": (f"<header><h1>Site</h1></header><main><header><h1>T</h1></header><div>{P}</div></main>", ["T", LONG, LONG]),
    "a short paragraph beside the entry": (f'<div><div class="entry">{P}</div><p>The end.</p></div>', [LONG, LONG, "The end."]),
    "two articles": (f"<main><article><h2>A</h2>{P}</article><article><h2>B</h2><p>Short.</p></article></main>", ["A", LONG, LONG, "B", "Short."]),
    "nested menus": (f'<div class="menu"><ul><li><a href=x>A</a><ul><li><a>B</a></ul></ul></div><div><ul><li><a>x</a><ul><li><a>y</a></li></ul></li></ul>{P}</div>', [LONG, LONG]),
    "a form around the page": (f'<form id="aspnetForm"><div id="content">{P}</div></form>', [LONG, LONG]),
    "a form on the page": (f"<div>{P}<form><p>name, name, name</p></form></div>", [LONG, LONG]),
    "comments longer than the post": (f'<div class="post">{P}</div><div id="comments"><article class="comment"><p>{LONG * 9}</p></article></div>', [LONG, LONG]),
    "an advert longer than the article": (f'<div class="ad">{LONG * 4}</div><article><p>Te.</p></article><footer>{LONG}</footer>', ["Te."]),
    "an advert longer than the text": (f'<div class="ad">{LONG * 4}</div><div><p>Te.</p></div>', ["Te."]),
    "a hidden part and a title that says hidden": (f'<div title="the hidden door">{P}<p hidden>x</p><p style="display:none">y</p></div>', [LONG, LONG]),
    "a list of links in an article": ("<article><p>See, for more:</p><ul><li><a href=a>one</a><li><a href=b>two</a></ul></article>", ["See, for more:", "one", "two"]),
    "chapters named as parts of a page are": (f'<article><h1>T</h1><section id="search"><h2>Search</h2><p>{LONG}</p></section><h2 id="comments">On comments in code</h2><p>{LONG}</p><div id="the-menu"><h3>The <i>menu</i></h3><p>Short.</p></div></article>', ["T", "Search", LONG, "On comments in code", LONG, "The menu", "Short."]),
    "reader comments in an article": (f'<article>{P}<section id="comments"><h2>Comments</h2><p>{LONG}</p></section></article>', [LONG, LONG]),
    "a search box in an article": (f'<article>{P}<div id="search"><form><input> find it</form></div><div id="menu"><h2>Menu</h2><a href=a>one</a> <a href=b>two</a></div></article>', [LONG, LONG]),
    "a class on a heading": (f'<article>{P}<h2 class="sidebar">Side</h2></article>', [LONG, LONG]),
    "a list of links under its heading": (f'<div class="content">{P}<h2>Sources</h2>\n<ul><li><a href=a>one</a><li><a href=b>two</a></ul></div>', [LONG, LONG, "Sources", "one", "two"]),
    "a list of links under a menu's heading": (f'<div class="content">{P}<h2>Related</h2><ul><li><a href=a>one</a></ul></div>', [LONG, LONG, "Related"]),
    "controls in a sentence": (f"<article>{P}<p>Press <button><b>Save</b></button> and <label>Name</label> it.</p><p><button>Share</button></p></article>", [LONG, LONG, "Press Save and Name it."]),
    "long attributes": (f'<article><p data-x="{"a > b " * 3000}">{LONG}</p><img alt=\'{"x>" * 9000}\'><p title=it"s>{LONG}</p></article>', [LONG, LONG]),
    "a quote that is not closed": (f'<article><p>{LONG}</p><p title="x>{LONG}</p></article>', [LONG, LONG]),
    "references and white space": ("<article><p>a&nbsp;&amp;\n\t b<br>c &lt;p&gt;</p></article>", ["a & b c <p>"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, blocks = PAGES[name]
    assert extract(f"<html><head><title>t</title></head><body>{html}</body></html>").split("\n\n") == blocks


def test_nothing():
    assert [extract(h) for h in (None, "", "<nav>a</nav>", '<div class="ad">buy</div>', "<script>x</script>", " \n ")] == [""] * 6


@pytest.mark.parametrize("shape", ["<b>{n}</i>{n}", "<title>{n}", "<b>{n}<p></p>{n}", "<div>{n}</div></span>{n}", "<table><tr><td><table>{1}<div>{n}<td></td>{n}", "<ul><li>{n}<li>{n}", "<p><b>{n}", "<a b=\"{n}", "<a b=\"c\" {n}", "<ul><li><a>x</a></ul>{n}", "<h2>a</h2><ul><li><a>x</a></ul>{n}"])
def test_time_is_linear(shape):
    def page(n):
        parts = shape.replace("{1}", "\0").split("{n}")
        return "".join(p.rpartition("\0")[0] + p.rpartition("\0")[2] * n for p in parts[:-1]) + parts[-1]

    def seconds(n):
        began = time.process_time()
        extract(page(n))
        return time.process_time() - began

    small, large = seconds(10_000), seconds(100_000)
    assert large < 30 * small + 1


def test_repeats_and_clashes(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", 3)] * 3 + [(None, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    assert sorted(map(tuple, html_extract(table).collect()), key=str) == sorted([(1, "u", LONG, len(LONG))] * 3 + [(None, None, "", 0)], key=str)
    assert html_extract(table.limit(0)).count() == 0
