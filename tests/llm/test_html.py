"""Operator 1 against the texts that pages were made of."""

import html
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from tablewright.llm import html_text
from tablewright.llm.dom import Page


def expected(source):
    """Blocks of the one article of the given pages, cut out by pattern."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1|article)>", re.sub(r"</?b>|<br>", " ", body))
    out = [re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts]
    return "\n".join(x for x in out if x)


def test_op1_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == expected(r["html"]) and got[r["page_id"]]["n_chars"] == len(expected(r["html"])), r["page_id"]


RICH = """<html><head><title>T</title></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head&amp;line</h1><p>First &lt;para&gt;
 with <b>bold</b> and <a href="#">link</a>.</p><p>Second&#233;<br>line<ul><li>item one<li>item two</ul><aside>Related</aside>
<form><p>Sign up <input></form><script>if (a < b) "</p>"</script><blockquote>Quoted words, at some length.</blockquote></article>
<section id="comments"><p>A reader's comment that is long, and has points.</p></section></main><footer>(c)</footer>"""
PLAIN = "<body><div><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></div><div>" + "".join(f"<p>This is paragraph {i}, which has some words, and points; it goes on for quite a while so as to be text.</p>" for i in range(6)) + "</div>"


def test_op1_rich_plain_and_edges(spark, sf):
    model = html_text.fit(spark.read.parquet(f"{sf}/pages.parquet"))
    rows = [(1, "u", RICH), (2, "u", None), (3, "u", ""), (4, None, "no tags at all"), (5, "u", PLAIN), (5, "u", PLAIN), (None, "u", "<p"), (6, "u", "<article>" + "<p>long text here.</p>" * 20_000),
            (7, "u", "<!-- open <p>x"), (8, "u", "<div " + 'a="' * 5000), (9, "u", "<b>" * 3000 + "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, model).collect()}
    assert got[1] == "Head&line\nFirst <para> with bold and link.\nSecondé line\nitem one\nitem two\nQuoted words, at some length."
    assert got[2] == got[3] == got[7] == "" and got[6].count("\n") == 19_999
    assert "paragraph 5" in got[5] and "x y z" not in got[5]
    assert html_text.extract(df.limit(0)).count() == 0 and html_text.extract(df.filter("page_id = 2")).first()["text"] == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=2, max_size=9), st.data())
def test_decoding_is_the_best_consistent_choice(odds, data):
    parent = [-1] + [data.draw(st.integers(0, i - 1)) for i in range(1, len(odds))]
    odds = np.array(odds)
    value = lambda kept: sum(-np.logaddexp(0, -o if k else o) for o, k in zip(odds[1:], kept[1:]))
    kept = html_text.decode(parent, odds)
    assert kept[0] and all(not kept[i] or kept[parent[i]] for i in range(1, len(odds)))
    best = max(value(c) for m in range(1 << (len(odds) - 1)) for c in [[True] + [bool(m >> i & 1) for i in range(len(odds) - 1)]] if all(not c[i] or c[parent[i]] for i in range(1, len(odds))))
    assert value(kept) >= best - 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pba\"'= !-&;", max_size=60))
def test_reader_takes_anything(source):
    p = Page(source)
    x, y = p.features()
    assert len(x) == len(y) == len(p.tag) and all(p.parent[i] < i for i in range(len(p.tag)))
    p.text([True] * len(p.tag))
