import re
import time
import tracemalloc
from collections import Counter
from html import unescape


from ledgerloom.llm import html, queries

PAGES = "page_id long, url string, html string"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


FULL = page("""
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-7">Buy</div>
<div class="wrap-12"><div class="post post-34"><h2>Title &amp; more</h2>
<p>First  <b>bold</b>\n line&nbsp;here.<br>Next &lt;line&gt; &#233;<p>Second <a href="x>y">link</a> words
<ul><li>one<li>two</ul><script>var t = "</p>";</script><style>p{}</style>
<table><tr><td>a<td>b<tr><td>c</table><blockquote>quoted</blockquote>
<form><p>Your mail</p></form><aside>side</aside><!-- <p>gone</p> --></div>
<section class="comments"><p>Nice post by a reader who wrote a lot of words</p></section></div>
<div class="sidebar"><p>Other things</p></div><footer>&copy; x</footer>""")



def rows_of(spark, pages):
    df = spark.createDataFrame(pages, PAGES)
    return {r.page_id: r for r in html.extract(df).collect()}


def test_one_page_with_everything_around_the_article():
    tree = html.parsed(FULL)
    node, _ = tree.choice()
    assert tree.path(node) == ">html>body>div.wrap-#>div.post.post-#"
    assert tree.text(node).split("\n\n") == [
        "Title & more", "First bold line here. Next <line> é", "Second link words", "one", "two",
        "a b", "c", "quoted"]


def test_broken_markup():
    for text in ("", "<", "a < b", "<p", "<p class='x>open", "</p></div>", "<script>never ends",
                 "<!-- open", "<a href=\"q>t</a>", "x" * 200_000, "<b>" * 3000 + "deep"):
        html.parsed(text).choice()
    assert [t for _, t, _ in html.blocks("1 < 2 <p>and<p>more")[0]] == ["1 < 2", "and", "more"]


def test_host_vote_overrules_a_page(spark):
    def made(article, other):
        return page(f"<div class='a1'><p>{article}</p></div><div class='b2'><p>{other}</p></div>")

    pages = [(i, "http://h.example/x", made("long article text " * 20, "short")) for i in range(9)]
    pages.append((9, "http://H.example:80/y", made("tiny", "an odd long box " * 20)))
    pages.append((10, "http://h.example/z", made("", "an odd long box " * 20)))
    pages.append((11, "http://other.example/", made("tiny", "an odd long box " * 20)))
    pages.append((12, None, made("long article text " * 20, "short")))
    pages.append((13, "http://h.example/n", page("<main><p>another template</p></main>")))
    got = rows_of(spark, pages)
    assert got[9].text == "tiny" and got[10].text == "" and got[11].text.startswith("an odd")
    assert got[12].text == got[0].text == ("long article text " * 20).strip()
    assert got[13].text == "another template"


def test_votes_are_counted_by_host_and_path(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    counted = {(r.host, r.path): r.n for r in html.votes(df).collect()}
    plain = Counter()
    for r in df.collect():
        tree = html.parsed(r.html or "")
        node, score = tree.choice()
        path = tree.path(node)
        if score > 0:
            plain[(re.match(r"https?://([^/:]+)", r.url)[1].lower(), path)] += 1
    assert counted == plain


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, None), (1, "", ""), (None, "http://h.example/", FULL), (2, "x", FULL), (2, "x", FULL)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS host", "3 AS path")
    out = html.extract(df).collect()
    assert sorted(r.n_chars for r in out)[:2] == [0, 0] and len(out) == 5
    assert len({r.text for r in out if r.page_id != 1}) == 1
    assert html.extract(df.limit(0)).count() == 0


def test_whole_table_against_a_plain_cut(spark):
    """The given pages keep their article between two tags; blocks end at few tags."""
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op3_host_consensus"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        source = pages[r.page_id]
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source.html, re.S)[1]
        cut = [" ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b))).split())
               for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, cut)) and r.n_chars == len(r.text)
        assert r.url == source.url


def test_wrappers_with_words_of_asides_keep_their_article():
    text = "the article has quite some words of its own " * 5
    side = "<div class='sidebar'><p>Other things</p></div>"
    for opened, closed in (("<div class='layout with-sidebar'>", "</div>"),
                           ("<div class='site-content no-sidebar'>", "</div>"),
                           ("<div class='page has-banner'>", "</div>"),
                           ("<div id='sidebarLayout'>", "</div>"),
                           ("<article class='post hentry comments-open'>", "</article>"),
                           ("<article class='promo'>", "</article>"),
                           ("<div class='social'><main>", "</main></div>"),
                           ("<x-app class='banner'>", "</x-app>")):
        found, _ = html.blocks(page(f"{opened}<p>{text}</p>{side}{closed}<div id='comments'>Nice</div>"))
        assert [t for _, t, _ in found] == [text.strip()], opened


def test_an_aside_with_articles_goes_where_the_page_has_a_longer_one():
    body = ("<article><p>the page's own article, of many words</p></article>"
            "<div class='related'><article><p>a short card</p></article></div>")
    assert [t for _, t, _ in html.blocks(page(body))[0]] == ["the page's own article, of many words"]
    short = "<div class='ad'>an advert longer than the text</div><article>short</article>"
    assert [t for _, t, _ in html.blocks(page(short))[0]] == ["short"]
    inside = "<main><h1>Title</h1><div class='social-post'>the whole of the story</div></main>"
    assert [t for _, t, _ in html.blocks(page(inside))[0]] == ["Title", "the whole of the story"]
    card = "<div class='related'><article><p>a card</p></article></div><p>plain words around it</p>"
    assert [t for _, t, _ in html.blocks(page(card))[0]] == ["a card", "plain words around it"]


def test_title_and_lead_stay_in():
    long = "a long body of many words " * 40
    for body in (f"<div class='post'><h1>Title</h1><p>lead</p><div class='entry'><p>{long}</p></div></div>",
                 f"<div class='post'><div class='top'>Title</div><p>lead</p><div><div>{long}</div></div></div>",
                 f"<div class='title'><h1>Title</h1></div><p>lead</p><div class='entry'>{long}</div>",
                 f"<div class='title'><h1>Title</h1> <p>lead</p></div><div class='entry'>{long}</div>"):
        tree = html.parsed(page(body))
        assert tree.text(tree.choice()[0]) == f"Title\n\nlead\n\n{long.strip()}"


def test_a_page_of_a_second_template_keeps_its_article(spark):
    long = "a long body of many words " * 20
    first = page(f"<div class='post'><h1>T</h1><p>{long}</p></div><div class='foot'>by us</div>")
    pages = [(i, "http://h.example/x", first) for i in range(30)]
    for i, box in ((50, ""), (51, "<p>short box</p>")):
        pages.append((i, "http://h.example/y", page(
            f"<div class='post'>{box}</div><div class='story'><h1>S</h1><p>{long}</p></div>")))
    # A short page of the first template keeps its short text.
    pages.append((52, "http://h.example/z", page(
        f"<div class='post'><h1>T</h1></div><div class='foot'>{long}</div>")))
    got = rows_of(spark, pages)
    assert got[0].text == f"T\n\n{long.strip()}"
    assert got[50].text == got[51].text == f"S\n\n{long.strip()}"
    assert got[52].text == "T"


def test_pages_of_notices_have_no_text(spark):
    for name in ("cookie-notice", "modal popup", "newsletter", "advert"):
        only = page(f"<div class='{name}'><p>We would like you to read this first.</p></div>")
        assert html.blocks(only)[0] == []
        assert rows_of(spark, [(1, "http://h.example/x", only)])[1].text == ""


def test_deep_and_unclosed_markup_costs_what_its_length_does():
    """Seconds and 500 MB for pages that are a few hundred kilobytes of open elements."""
    pages = {
        "inline": "<b>x" * 100_000, "blocks": "<div>a" * 10_000, "asides": "<div class=widget>a" * 10_000,
        "ends without starts": "<b>" * 50_000 + "</i>" * 50_000 + "<div></div>" * 50_000,
        "ends in vain": "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "cells": "<table>" + "<td><b>" * 30_000}
    for name, body in pages.items():
        tracemalloc.start()
        start = time.perf_counter()
        tree = html.parsed("<html><body>" + body)
        node, _ = tree.choice()
        tree.text(node)
        deepest = tree.path(len(tree.parent) - 1)
        assert tree.named(deepest) == len(tree.parent) - 1
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.perf_counter() - start < 20 and peak < 500 << 20, name
    deep = html.parsed("<html><body>" + "<div>" * 3000 + "deep" + "</div>" * 3000)
    assert [t for _, t, _ in deep.found] == ["deep"] and len(deep.path(deep.found[0][0])) < 60
