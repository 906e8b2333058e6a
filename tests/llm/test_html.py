"""Visible text of pages: hand-made layouts, random trees against a collector of their visible words, broken markup, odd tables."""

import itertools
import random
import re
import time

import pytest

from tidepanel.llm import html_text
from tidepanel.llm.html_text import render


def test_layout():
    assert render(None) == render("") == ""
    assert render("<head><title>x</title></head><p>a<b> b</b>c<p>d<script>z</script><div hidden>no</div>") == "a bc\n\nd"
    assert render("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>") == "- x\n- y\n  1. 1\n  2. 2"
    assert render("<ol start=5><li>a<li value=9>b<li>c</ol>") == "5. a\n9. b\n10. c"
    assert render("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>") == "a    bb\nccc  d"
    assert render("<p>x</p> <p>y</p>z<div>u</div><div>v</div>") == "x\n\ny\n\nz\nu\nv"
    assert render("<pre>\n a  b\n\n\n  c</pre>x") == " a  b\n\n\n  c\n\nx"
    assert render("a<br>b<br><br>c") == "a\nb\n\nc" and render("<ul><li><p>a<p>b<li></ul>") == "- a\n  b"
    assert "broken" in render("<div><p>broken <b>&amp; <td")


def test_spans_and_lines_of_cells():
    assert render("<table><tr><td colspan=2>wide wide<td>x<tr><td>a<td>b<td>c</table>") == "wide wide  x\na  b       c"
    assert render("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>") == "r  x\n   y"
    assert render("<table><tr><td>a<br>b<td><ul><li>p<li>q</ul></table>") == "a  - p\nb  - q"
    assert render(f"<table><tr><td>{'w' * 130}<td>x</table>") == "w" * 130 + "\nx"


def test_what_is_hidden():
    assert render("<div>" * 205 + "<div hidden>SECRET</div>") == ""
    assert render("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>") == "yes"
    assert render("<p style='x-display:none'>yes<p style='display:block; DISPLAY : none'>no<p hidden style='display:block'>yes") == "yes\n\nyes"
    assert render("a<template>b</template><dialog>c</dialog><dialog open>d</dialog><noscript>e</noscript>") == "a\nd"


def test_a_head_ends_by_itself():
    assert render("<head><title>T</title><p>Hello <b>you</b>") == render("<!doctype html><html><head><title>T</title><meta charset=x>Hello you") == "Hello you"
    assert render("<head><noscript><img alt=no></noscript><script>if (a<b) c</script> <style>p</style>\n<div>yes</div><head>too") == "yes\ntoo"
    assert render("<html><head><title>x</title></head><body>a</body></html>") == "a"


def test_tables_lose_no_text():
    assert render("<table><td>a</td><td>b</td></table>") == render("<table><tbody><td>a<th>b</table>") == render("<table><tr><form><td>a</td></form><td>b</td></tr></table>") == "a  b"
    assert render("<div><table><tr><div><td>a</td></div><td>b</td></tr></table>c</div>") == "a  b\n\nc"
    assert render("<div>x <table>one<tr>two <b>three</b><td>a</td>four</tr>\n</table>y</div>") == "x onetwo threefour\n\na\n\ny"
    assert render("<table><caption>k<td><ul><li>p<li>q</ul><td><table><td>in</table>r<tr><td>z</table>") == "k\n- p  in\n- q  r\nz"
    assert render("<table>stray<tr><td>a<div>inner</div></table>") == "stray\n\na\ninner" and render("<table><tr>loose<td>a") == "loose\n\na"
    assert render("<td>a</td> b") == "a b"
    deep = "<div>" * 1999 + "<table>s<tr><td>t</table>"
    assert render(deep) == "s\n\nt"
    assert all(f"x{k}y" in render("".join(f"<table><td>x{k}y" for k in range(40))) for k in range(40))


BLOCKS, INLINE = ["div", "p", "section", "blockquote", "h2", "pre", "ul", "ol", "article"], ["b", "i", "span", "a", "code"]


def made(r, depth, hidden, shown, words):
    """A random well-formed piece; its visible words in order are appended to shown."""
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < 0.4 or depth > 5:
            word = f"w{next(words)}"
            out.append(word + " ")
            if not hidden:
                shown.append(word)
        elif kind < 0.5:
            out.append(f"<script>var w{next(words)} = 'a<b';</script><!-- w{next(words)} --><style>w{next(words)}</style>")
        elif kind < 0.6:
            off = r.random() < 0.5
            look = r.choice([" hidden", ' style="display:none"', " style='color: red; Display:NONE'"]) if off else r.choice(["", ' class="hidden"', " title='display:none'"])
            out.append(f"<div{look}>{made(r, depth + 1, hidden or off, shown, words)}</div>")
        elif kind < 0.7:
            tag = r.choice(INLINE)
            word = f"w{next(words)}"
            shown += [word] * (not hidden)
            out.append(f"<{tag}>{word}</{tag}> ")
        elif kind < 0.8:
            rows = []
            for _ in range(r.randint(1, 3)):
                cells = [f"w{next(words)}" for _ in range(r.randint(1, 3))]
                shown += [] if hidden else cells
                rows.append("<tr>" + "".join(f"<td>{c}" + r.choice(["", "</td>"]) for c in cells) + r.choice(["", "</tr>"]))
            out.append(f"<table>{''.join(rows)}</table>")
        else:
            tag = r.choice(BLOCKS)
            if tag == "p":  # left open: the next block ends it
                word = f"w{next(words)}"
                shown += [word] * (not hidden)
                out.append(f"<p>{word}")
                tag = "section"
            inner = made(r, depth + 1, hidden, shown, words)
            if tag in ("ul", "ol"):
                inner = f"<li>{inner}" + r.choice(["", "</li>"])
            out.append(f"<{tag}>{inner}</{tag}>")
    return "".join(out)


def test_all_visible_words_in_order():
    for seed in range(400):
        r, shown = random.Random(seed), []
        html = made(r, 0, False, shown, itertools.count())
        assert re.findall(r"w\d+", render(html)) == shown, html


def test_broken_markup_never_fails():
    r = random.Random(3)
    bits = ["<", ">", "</", "<!", "<!--", "-->", "<![", "]]>", "<?", "a", " ", "b=\"", "'", "=", "/", "<p", "<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "&amp;", "&#x41;", "&", "<script>", "</script>",
            "<title>", "<pre>\n", "\x00", "\r", "<select>", "<option>", "<svg/>", "<br/>", "</br>", "<h1>", "<caption>", "<template>", "</template>", "<body>", "</body>", "<head>", "<colgroup>", "<col>", "<form>", "<button>", "<dl><dt>", "<dd>", "<![endif--]>", "<plaintext>"]
    for _ in range(30_000):
        render("".join(r.choice(bits) for _ in range(r.randint(1, 14))))
    for html in ("<p>a<![foo bar]>b", "a<![endif]-->b", "<![]>ab", "a<?x?>b"):
        assert render(html) == "ab"


@pytest.mark.parametrize("part", ["a<", "<!--", "<div>", "<ul><li>", "<table><td>", "<table>x<tr><td rowspan=60000>x", '<a x="', "<p><b>", "<script>", "<b>x", "<table><b>", "<td colspan=1000>x", "</p>", "<a b='"])
def test_time_grows_with_length(part):
    began = time.time()
    render(part * (200_000 // len(part)))
    assert time.time() - began < 8


def test_pages_through_spark(spark):
    rows = [(1, "<p>a"), (2, None), (3, ""), (1, "<p>a"), (4, "<p>" + "word " * 400_000), (None, "<b>x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'k' AS key", "'t' AS text", "1 AS _row")
    got = sorted(((r["page_id"] or 0), r["text"]) for r in html_text.extract(pages.repartition(3)).collect())
    assert got == sorted([(0, "x"), (1, "a"), (1, "a"), (2, ""), (3, ""), (4, ("word " * 400_000).strip())])
    assert html_text.extract(pages).columns == ["page_id", "text"] and html_text.extract(pages.limit(0)).count() == 0
