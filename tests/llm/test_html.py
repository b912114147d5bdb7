"""Main text of pages: of the given ones, of pages laid out in other ways, and of broken markup."""

import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from reviewlake.llm import html_text
from reviewlake.llm.html_text import blocks, main_text
from reviewlake.llm.queries import QUERIES

LONG = "The committee met again on Tuesday to discuss the plans for the bridge, which many people in the valley had asked for since the flood."
LATER = "Work is to begin in spring; until then, the ferry will go on running twice an hour, on Sundays and holidays too, as it did last year."


def article(page):
    """The text of the one article of a given page, by its tags alone."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(part for part in parts if part)


def test_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op11_main_text"][0](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text) == (pages[r.page_id].url, article(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_news_page():
    page = f"""<!doctype html><html><head><title>Bridge &amp; ferry</title><script>if (a < b) document.write("<p>no</p>")</script>
    <style>p > a {{ color: red }}</style></head><body class="comments-open">
    <header class="site-header"><a href="/">The Valley</a><p>News from the valley since 1901, every day and for all who live here</p></header>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">Sport and games</a></ul></nav>
    <div id="cookieNotice"><p>{LATER}</p><button>I agree</button></div>
    <main><article><header><h1>A bridge at last</h1></header>
    <p>{LONG}</p><div class="ad-slot"><p>Buy two boats and get the third one free, this week only, while we have them.</p></div>
    <p>Short.</p><p>{LATER.replace("ferry", '<a href="/f">ferry</a>')}
    <ul class="share-links"><li><a href="#">Post</a><li><a href="#">Send</a></ul>
    <aside><p>{LONG}</p></aside>
    <form action="/s"><p>{LATER}</p><select><option>One<option>Two</select></form>
    <section id="comments"><h2>Two comments</h2><div class="comment"><p>{LONG}</p></div></section>
    </article></main><div class="sidebar"><p>{LATER}</p></div>
    <div hidden><p>{LONG}</p></div><div style="display: none"><p>{LONG}</p></div>
    <footer><p>{LATER}</p></footer></body></html>"""
    assert main_text(page).split("\n") == ["A bridge at last", LONG, "Short.", LATER]


def test_page_without_telling_elements():
    page = f"""<body><div><a href="/">Start</a> <a href="/2">Everything else</a></div><div><ul><li><a href="/x">One</a></li><li><a href="/y">Two more</a></li></ul></div>
    <div><div><h1>A bridge at last</h1><p>{LONG}</p><p>{LATER}</p><p>{LONG}</p></div>
    <div><ul><li><a href="/x">Older thing</a></li><li><a href="/y">Another one</a></li><li><a href="/z">And a third</a></li></ul></div></div>"""
    assert main_text(page).split("\n") == ["A bridge at last", LONG, LATER, LONG]


def test_article_beside_navigation():
    page = "<nav><a href=1>One</a> <a href=2>Two</a></nav><article><p>Yes.</p><p>No.</p></article><footer>(c) us</footer>"
    assert main_text(page) == "Yes.\nNo."
    assert main_text("<nav><a href=1>One</a></nav><article><p>Yes.") == "Yes."
    assert main_text(f"<nav><a href=1>One two three four five</a></nav><article><p>{LONG}</article>") == LONG


def test_names_of_elements():
    inside = lambda attributes, around=0: html_text.says("div", attributes, around) & html_text.ASIDE_FLAG
    for word in ("ad", "ad-slot", "topAdBanner", "COOKIE_notice", "x comments-area", "sidebar2"):
        assert inside(f'class="{word}"') and inside(f"id={word.split()[-1]}"), word
    for word in ("advanced", "with-sidebar wide", "has-ads", "headless", "content", "shadow"):
        assert not inside(f'class="{word}"'), word
    assert inside('class="post-header"') and not inside('class="post-header"', html_text.MAIN_FLAG)
    assert not inside('data-class="ad"') and inside("hidden") and inside("role=navigation") and not inside('title="class=ad"')


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(("page", "want"), [
    ("", []), (" \n\t", []), ("one", ["one"]), ("a < b <p>c > d", ["a < b", "c > d"]), ("<p>a<br>b</p>c", ["a b", "c"]), ("<p>a&nbsp;&amp;\n&#8364;&copyb</p>", ["a & €©b"]),
    ("<p>x<b>y</b>z</p>", ["xyz"]), ("<p>a<!-- <p>b --> c", ["a c"]), ("<p>a<!-- b", ["a"]), ("<p>a<!-->b", ["ab"]), ("<p>a<!x>b<?php x?>c</>d", ["abcd"]),
    ('<p title="a > b">c', ["c"]), ("<p title='a > b'>c", ["c"]), ("<p title=it's>c</p>", ["c"]), ('<p title="x>c</p>', ["c"]), ("<p>a</p", ["a"]), ("<SCRIPT>x</p></ScRiPt >y", ["y"]),
    ("<script>x", []), ("<p>a<textarea><p>b</textarea>c", ["a c"]), ("<li>a<li>b", ["a", "b"]), ("</div></p>a", ["a"]), ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]), ("<x-y>a</x-y>b", ["ab"]),
    ("<", ["<"]), ("a<", ["a<"]), ("<3", ["<3"]), ("<p>&lt;p&gt;b", ["<p>b"]), ("\x00<p>\ud83d", ["\x00", "\ud83d"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_links_are_counted():
    found = blocks('<p>one <a href="/">two three</a> four<a>five</a></p><a href=x><div>six seven</div></a>eight<div><a>nine</div>ten')
    assert [(b.words, b.linked) for b in found] == [(4, 3), (2, 2), (1, 0), (1, 1), (1, 0)]


def test_unclosed_markup_takes_linear_time():
    for piece in ('<a "', "<a '\"><b ", "<div><p><b>", "<!", "<script", '<p class="', "<a b=' ", "&", "<p x=", "< ", "</div>", "<div", '<p class="a" '):
        page = piece * (400_000 // len(piece))
        assert main_text(page) is not None  # some 0.1 s each; quadratic work would take minutes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "word ", "<article>", "</article>", "<!--", "-->", "<br>", "&amp", "\"", ">", "<", "<nav>", "</nav>", "<script>", "</script>", "<li>", "é "]), max_size=30))
def test_any_markup(parts):
    page = "".join(parts)
    for b in blocks(page):
        assert b.text == " ".join(b.text.split()) and b.words == len(b.text.split()) > 0 and 0 <= b.linked <= b.words
    assert set(main_text(page).split("\n")) <= {b.text for b in blocks(page)} | {""}


def test_tree_splits_as_an_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.integers(0, 5, (40, 3)).astype(float)
        y = (x[:, 1] + rng.integers(0, 3, 40) > 3).astype(int)
        tree = html_text.train(x, y, least=1, deepest=1)
        best = min(
            sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[x[:, f] <= t], y[x[:, f] > t]))
            for f in range(3) for t in np.unique(x[:, f])[:-1]
        )
        left = x[:, tree.feature[0]] <= tree.threshold[0]
        own = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
        assert abs(own - best) < 1e-9
        assert (tree.content(x) == np.where(left, y[left].mean() >= 0.5, y[~left].mean() >= 0.5)).all()


def test_odd_rows(spark):
    rows = [(1, "u", "<p>" + LONG, 3, "t", 9), (1, "u", "<p>" + LONG, 3, "t", 9), (2, None, None, 3, "t", 9), (3, "v", "", 3, "t", 9), (None, "w", "<nav>x</nav>", None, None, None), (4, "x", "<p>" + "long text " * 200_000, 3, "t", 9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_words int, text string, n_chars int")
    found = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(table).collect()), key=str)
    long = ("long text " * 200_000).strip()
    assert found == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (0, "w", "", 0), (4, "x", long, len(long))], key=str)
    assert html_text.extract(table.where("false")).collect() == []
