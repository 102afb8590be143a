from __future__ import annotations

import html as H
import random
import re

import pytest

from basketry.llm.html import content_paths, extract, main_text

LONG = "A sentence, and then another one; it goes on for a while. So does this, as a matter of fact!"


def page(body, head="<title>T</title><script>var t='</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy this, now. Really, do!</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; me</footer>", f"Title {LONG} Short."),
    "div soup": (f"<div id='top'><a href=a>One</a> <a href=b>Two</a></div><div id='content'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div>", f"Title {LONG} {LONG} Short."),
    "comments and form": (f"<main><p>{LONG}</p><form>Name <input> <button>Send</button></form><section id='comments'><p>{LONG}</p></section><aside>{LONG}</aside><p>End &amp; out</p></main>", f"{LONG} End & out"),
    "unclosed": (f"<article><h1>A<p><b>{LONG}<br><p>Next <i>one</b> two</article><footer>{LONG}", f"A {LONG} Next one two"),
    "inline keeps words whole": (f"<article><p>{LONG}</p><p>un<b>believ</b>able<br>yes\n\t no&nbsp;x</p></article>", f"{LONG} unbelievable yes no x"),
    "list and table": (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG} one two a b c"),
    "header of the page": (f"<header><h1>Site, the. Name!</h1><p>{LONG}</p></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title {LONG}"),
    "comment and hidden": (f"<!-- <p>{LONG}</p> --><article><p hidden>no</p><p>{LONG}</p><script>x='<p>'</script></article>", LONG),
    "menu only": ("<nav><a href=x>Home</a></nav><footer>(c)</footer>", ""),
    "signs": (f"<article><p>{LONG}</p><p>a &lt; b &#38; c &#x41; &unknown; 1 < 2 > 0</p></article>", f"{LONG} a < b & c A &unknown; 1 < 2 > 0"),
}


@pytest.mark.parametrize("case", CASES)
def test_pages(case):
    body, want = CASES[case]
    assert main_text(page(body)) == want


def test_nothing_and_plain_text():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<html>") == main_text("<!--") == ""
    assert main_text(LONG) == LONG


def test_deep_and_long_pages_end_in_time():
    assert main_text("<div>" * 20000 + LONG) == LONG
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(8000))
    assert main_text(page(f"<article>{many}</article>")) == " ".join(f"{LONG} {i}" for i in range(8000))


def test_no_blocks():
    assert content_paths([]) == set()


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in rows.collect()}
    got = extract(rows).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inner))
        assert r.text == " ".join(H.unescape(plain).split()) and r.n_chars == len(r.text)


def test_pages_of_one_host_that_repeat_a_passage(spark):
    """Many pages with the same menu, the same long passage and little else."""
    head = "<html><body><nav><ul>" + "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(30)) + "</ul></nav>"
    foot = "<div class='comments'><p>Nice one, thanks a lot for this!</p></div><footer>Contact, imprint</footer></body></html>"
    rows = [(i, f"https://one.example/{i}", f"{head}<article><h1>Title {i}</h1><p>{LONG}</p><p>{LONG} {i}</p></article>{foot}") for i in range(40)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i} {LONG} {LONG} {i}" for i, _, _ in rows}


def test_marked_sections_are_comments():
    assert main_text("<![foo[ x ]]>") == "" and main_text("<![%x[") == ""
    for odd in ("<![foo[ x ]]>", "<![%x[>", "<![CDATA[ y ]]>", "<![if !IE]>", "<!ELEMENT a>", "<?php x ?>"):
        assert LONG in main_text(page(f"<p>{LONG}</p>{odd}<p>{LONG}</p>")), odd


def test_any_string_is_a_page():
    rng = random.Random(11)
    bits = ["<", "!", "[", "]", ">", "--", "%", "x", "<p>", "</p>", "<div class=a>", "<![", "CDATA[", "]]>", "&amp", "&#", "<!", "<?", "/", "'", '"', "="]
    bits += ["<script>", "</script", "<title>", "é", "<!DOCTYPE", "<!ELEMENT ", "<a href=", "\x00", "&#99999999999;", "<svg", "temp[", "</", "<li>", "<td>", "\ud7ff"]
    for _ in range(20000):
        text = main_text("".join(rng.choices(bits, k=rng.randint(1, 30))))
        assert text == " ".join(text.split())


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, page(f"<p>{LONG}</p>"), "x"), (2, "v", "", "x"), (2, "v", page(f"<p>{LONG}</p>"), "x"), (2, "v", page(f"<p>{LONG}</p>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = sorted(((r.page_id, r.url, r.text) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", ""), (None, None, LONG), (2, "v", ""), (2, "v", LONG), (2, "v", LONG)], key=str)
    assert extract(df.limit(0)).collect() == []


FAR = " ".join([LONG] * 3)
WRAPPED = {
    "names with main": (f"<div class='content-sidebar-wrap'><main><h1>T</h1><p>{FAR}</p></main><div class='sidebar'><p>{LONG}</p></div></div>", f"T {FAR}"),
    "names with article": (f"<div id='page' class='has-sidebar no-comments'><article><h1>T</h1><p>{FAR}</p></article><div class='related'><p>{LONG}</p></div></div>", f"T {FAR}"),
    "names without either": (f"<div id='page' class='no-comments'><div class='text'><p>{FAR}</p><p>{FAR}</p></div><div class='sidebar'>{LONG}</div></div>", f"{FAR} {FAR}"),
    "listed name": (f"<div class='widget'><div class='share'><article><p>{FAR}</p></article></div></div><div>All rights, reserved.</div>", FAR),
    "listed name alone": (f"<div class='notice'><p>{FAR}</p><p>{FAR}</p></div>", f"{FAR} {FAR}"),
    "wrapper in main": (f"<main><h1>T</h1><div class='content-sidebar'><p>{FAR}</p></div></main>", f"T {FAR}"),
    "one form": (f"<form id='aspnetForm'><div class='nav'><a href=x>Home</a></div><div id='c'><h1>T</h1><p>{FAR}</p><p>{FAR}</p></div></form>", f"T {FAR} {FAR}"),
    "form with article": (f"<form id='aspnetForm'><article><p>{FAR}</p><form><p>Name, please. Go on.</p></form></article><footer>{LONG}</footer></form>", FAR),
    "thread outweighs article": (f"<div id='page' class='no-ads'><article><p>{LONG}</p></article><section id='comments'>{'<article class=comment><p>' + FAR + '</p></article>'}{f'<p>{FAR}</p>' * 9}</section></div>", LONG),
    "thread outweighs div": (f"<div class='text'><p>{FAR}</p><p>{FAR}</p></div><div id='comments'>{f'<p>{FAR}</p>' * 8}</div>", f"{FAR} {FAR}"),
    "cards beside the text": (f"<div class='text'><p>{FAR}</p><p>{FAR}</p></div><div class='more-related'><article><p>{LONG}</p></article></div>", f"{FAR} {FAR}"),
    "unclosed nav": (f"<nav><a href=x>Home</a><main><p>{FAR}</p></main>", FAR),
    "hidden stays out": (f"<div hidden><main><p>{FAR}</p></main></div><div><p>{LONG}</p></div>", LONG),
}


@pytest.mark.parametrize("case", WRAPPED)
def test_names_of_wrappers_lose_nothing(case):
    body, want = WRAPPED[case]
    assert main_text(page(body)) == want


def test_deep_marks_end_in_time():
    assert main_text("<div class='no-ad'>" * 20000 + LONG) == LONG
    assert main_text("<div class='ad'>x, y.</div>" * 20000 + f"<p>{LONG} {LONG}</p>") == f"{LONG} {LONG}"


COMMENTS = {
    "in script": (f"<script>x='<!--'</script><article><p>{LONG}</p></article>", LONG),
    "around script": (f"<script><!-- run(); </script><article><p>{LONG}</p></article>", LONG),
    "in style": (f"<style><!-- p{{}} </style><article><p>{LONG}</p></article>", LONG),
    "in an attribute": (f"<div title='<!--'></div><article><p title=\"<!-- \">{LONG}</p></article>", LONG),
    "in textarea": (f"<textarea><!-- </textarea><article><p>{LONG}</p></article>", LONG),
    "in a comment": (f"<!-- <!-- --><article><p>{LONG}</p></article>", LONG),
    "other end": (f"<!-- <p>{LONG}</p> --!><article><p>{LONG}</p></article>", LONG),
    "empty": (f"<!--><article><p>{LONG}</p><!---><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    "without an end": (f"<article><p>{LONG}</p><!-- <p>{LONG}</p></article><script>x='--'</script>", LONG),
    "without an end after script": (f"<script>x='<!--'</script><article><p>{LONG}</p><!-- <p>{LONG}</p></article>", LONG),
}


@pytest.mark.parametrize("case", COMMENTS)
def test_comment_signs_outside_comments(case):
    body, want = COMMENTS[case]
    assert main_text(page(body)) == want


def test_comment_sign_in_title():
    assert main_text(page(f"<article><p>{LONG}</p></article>", "<title>a <!-- b</title>")) == LONG
