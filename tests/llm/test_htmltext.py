"""Main text of pages."""

from __future__ import annotations

import re
from html import unescape

from conftest import SMALL

from scanloom.llm import htmltext
from scanloom.llm.common import table


def test_tree_learns_its_table():
    tree = htmltext.default_tree()
    assert all(htmltext.classified(tree, row[:-1]) == row[-1] for row in htmltext.LABELLED)


def test_pages_give_their_articles(spark):
    got = {r.page_id: r for r in htmltext.extracted(table(spark, SMALL, "pages")).collect()}
    for page in table(spark, SMALL, "pages").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", page.html)[1]
        parts = (" ".join(unescape(re.sub(r"</?b>|<br>", lambda m: " " if "br" in m[0] else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[page.page_id].text == "\n".join(p for p in parts if p)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url


def test_what_is_not_main_text_goes():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies on this long page about many things.</div>
    <main><article><h1>Title &amp; more</h1><p>First   para&nbsp;with <a href="?a>b">link</a> in it.</p><aside>side</aside><!-- <p>no</p> -->
    <p>Second<br>line<form><input>subscribe</form><ul><li>one<li>two</ul><p>tail &lt;b&gt; &#233;</article>
    <section class="comments"><article>Nice text of some length by a reader, who goes on.</article></section></main>
    <div class="sidebar"><p>More on this</p></div><footer>&copy; x</footer><script>var a="<p>no</p>"</script>"""
    assert htmltext.main_text(html) == "Title & more\nFirst para with link in it.\nSecond line\none\ntwo\ntail <b> é"


def test_pages_without_article_elements():
    long = "word " * 60
    html = f"<div class=menu><a href=a>A</a> <a href=b>B</a></div><div><p>{long}</p><p>short between</p><p>{long}</p></div><p><a href=x>x</a> | <a href=y>y</a></p>"
    assert htmltext.main_text(html) == "\n".join([long.strip(), "short between", long.strip()])


def test_odd_markup():
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>" * 3000) == ""
    assert htmltext.main_text("plain text") == "plain text"
    for html in ('<div "' * 20_000, "<a " * 20_000 + ">", "<p " + '"' * 50_001, "<div>" * 20_000 + "x", "</p>" * 20_000, "&" * 20_000):
        htmltext.main_text(html)
    many = "<article>" + "<p>one two</p>" * 20_000 + "</article>"
    assert htmltext.main_text(many).count("\n") == 19_999


def test_odd_rows(spark):
    rows = [(1, None, None, 3), (None, "u", "<article><p>a</p></article>", 4), (2, "u", "", 5), (2, "u", "", 5)]
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()))
    assert got == [(0, "u", "a", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0)]


def without_containers(html: str) -> str:
    """The page with plain containers and no class names."""
    return re.sub(r' class="ad"', "", re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", html))


def test_words_and_links_decide_without_containers(spark):
    for page in table(spark, SMALL, "pages").collect():
        plain = without_containers(page.html)
        assert not any(b[3] or b[4] for b in htmltext.blocks_of(plain)[0])
        assert htmltext.main_text(plain) == htmltext.main_text(page.html)


def test_neighbours_change_verdicts():
    block, long = "<p>A sentence of seven words stands here.</p>", f"<p>{'word ' * 50}</p>"
    link, text = "<p><a href=x>Go on</a></p>", "A sentence of seven words stands here."
    kept = {name: text in htmltext.main_text(html) for name, html in {"between text": long + block + long, "after links": long + link + block + link, "at the end": long + block, "alone": block}.items()}
    assert kept == {"between text": True, "after links": False, "at the end": False, "alone": True}


def test_link_density_changes_verdicts():
    long = f"<p>{'word ' * 50}</p>"
    for share, kept in ((0, True), (20, False)):
        words = ["word"] * (20 - share) + ["<a href=x>word</a>"] * share
        assert (htmltext.main_text(long + f"<p>{' '.join(words)}</p>" + long).count("\n") == 2) is kept
    tree = htmltext.default_tree()
    assert htmltext.FEATURES[tree[0]] in ("words", "links", "words_before", "links_before", "words_after", "links_after")
