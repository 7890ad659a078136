"""Hand-labelled pages, none of them laid out by the training generator, and pages of broken or deep markup."""

import time

import pytest

from tessergraph.llm import html

PAGES = {
    "blog": (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A walk | My blog</title><script>var a = "<p>no</p>";</script></head><body class="single">
        <header class="site-header"><a href="/">My blog</a><p class="tagline">Notes on walking</p></header>
        <nav class="primary-nav"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></nav>
        <div class="cookie-notice">We use cookies to improve your experience. <button>Accept</button></div>
        <main id="content"><article class="post"><h1>A walk by the river</h1>
        <p>We left the house at six, when the mist still lay over the meadows &ndash; and it was cold.</p>
        <p>The path follows the river for three miles. It then climbs to a <a href="/chapel">small chapel</a> on the hill.</p>
        <blockquote><p>Nobody comes here in winter, the old man said.</p></blockquote>
        <ul><li>Bring water.</li><li>Wear good shoes.</li></ul></article>
        <section class="comments"><h3>2 comments</h3><div class="comment"><p>Lovely walk, I did it last year with my dog.</p></div><div class="comment"><p>Where can one park the car there?</p></div></section></main>
        <aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Ten hills</a></li><li><a href="/2">Boots</a></li></ul></aside>
        <footer class="site-footer"><p>&copy; 2020 My blog. All rights reserved.</p></footer></body></html>""",
        [
            "A walk by the river", "We left the house at six, when the mist still lay over the meadows – and it was cold.",
            "The path follows the river for three miles. It then climbs to a small chapel on the hill.", "Nobody comes here in winter, the old man said.", "Bring water.", "Wear good shoes.",
        ],
    ),
    "news in divs": (
        """<html><body><div id="header"><div class="logo">The Daily</div></div><div id="menu"><a href=a>World</a> | <a href=b>Sport</a> | <a href=c>Culture</a></div>
        <div id="main"><div class="article-body"><h1>Bridge reopens</h1><p>The old bridge reopened on Monday after two years of work.</p>
        <div class="ad-banner"><p>Buy one, get one free, only this week in our shop.</p></div>
        <p>Traffic over it is limited to cars &amp; bicycles, the mayor said.</p><p>Work cost four million.</p></div>
        <div class="share">Share this: <a href=f>F</a> <a href=t>T</a></div></div>
        <div class="related"><h3>Related</h3><ul><li><a href=1>Tunnel closed</a></li><li><a href=2>New road</a></li></ul></div><div id="footer">Contact | Imprint</div></body></html>""",
        ["Bridge reopens", "The old bridge reopened on Monday after two years of work.", "Traffic over it is limited to cars & bicycles, the mayor said.", "Work cost four million."],
    ),
    "manual": (
        """<body><nav><a href=#1>Install</a><a href=#2>Use</a></nav><main><h1>Manual</h1><h2>Install</h2><p>Copy the file to a folder<br>of your own.</p>
        <table><tr><td>size</td><td>the number of rows</td></tr></table><h2>Use</h2><p>Call it by name.</p></main><footer><p>Version 2</p></footer></body>""",
        ["Manual", "Install", "Copy the file to a folder of your own.", "size", "the number of rows", "Use", "Call it by name."],
    ),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_labelled_pages(name):
    page, blocks = PAGES[name]
    got = html.extract(page, html.train()).split("\n\n")
    assert sum(b in got for b in blocks) >= 0.9 * len(blocks) and sum(g in blocks for g in got) >= 0.9 * len(got)


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "<div>" * 60_000 + "</p></b></i>" * 30_000, "<b>" * 20_000 + "<table><tr><td>" + "<div>" * 20_000 + "</b>" * 20_000, "<div class='" + "a b " * 4_000 + "'>" + "<p>x</p>" * 10_000,
     "<a '" * 80_000 + '<b "' * 80_000, "<script></script " * 50_000, "<!--" * 200_000, "<a" * 300_000, "<p>x " * 50_000],
)
def test_time_follows_the_length(page):
    model = html.train()
    html.extract(page[: len(page) // 8], model)
    began = time.process_time()
    html.extract(page, model)
    assert time.process_time() - began < 15  # hours, if it grew with the square


def test_tokens():
    assert [(t[2], t[3]) for t in html._tokens("a<b x='>'>c</b><!-- <i> --><!doctype y><script><p></script ><br/>< d <e 'f")] == [("", "b"), ("/", "b"), ("", ""), ("", ""), ("", "script"), ("", "br")]
    assert html.extract("<article><p>x &lt; y <z and no end", html.train()).startswith("x < y")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract_pages(pages).collect() == []
