"""Main text of pages."""

import html
import re
import time

import pytest

from labelloom.llm import main_text, queries

PRIOR = main_text.weights({})


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("plain words only", "plain words only"),
    ("<p>a<!-- x", "a"),
    ("<p>1 < 2 &amp; &quot;x&quot;&nbsp;&eacute;</p>", '1 < 2 & "x" é'),
    ('<p>See <a href="q>r">th</a>is <b>bo</b>ld.<br>next</p>', "See this bold. next"),
    ("<script>var x='<p>no</p>'</script><p>yes it is</p><style>p{}</style>", "yes it is"),
    ('<nav><a>Home</a> <a>News</a></nav><div class="post"><h1>T</h1><p>First   part of it</p>'
     '<div class="ad">Buy now</div><aside>Other links</aside><p>second part of it</p></div>'
     '<div id="comments"><p>Nice one thanks</p></div><footer>All rights</footer>',
     "T First part of it second part of it"),
    ('<div class="cookie-banner">We use cookies</div><main><p>one two three</p><form>your mail</form></main>', "one two three"),
    ("<nav>only a menu here</nav><footer>and a footer</footer>", ""),
])
def test_examples(page, text):
    assert main_text.extract(page, PRIOR) == text


def test_unclosed_and_stray_tags():
    assert main_text.extract("<article><p>one two<p>three</b></p></div>four</article>", PRIOR) == "one two three four"


def test_nulls_clashing_names_and_empty_tables(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article><p>a b c</p></article>", "x"), (None, None, None, "y"), (2, "", "", "z"), (2, "", "", "z")],
        "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in main_text.main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a b c"), (None, None, ""), (2, "", ""), (2, "", "")], key=str)
    assert main_text.main_text(pages.limit(0)).collect() == []


def test_query_gives_every_article(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op9_main_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^<>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


BODY = "<p>" + "one two three four five six seven eight nine ten " * 5 + "</p>"
WORDS = ("one two three four five six seven eight nine ten " * 5).strip()


@pytest.mark.parametrize("page", [
    "<p>a b c</p><a " + " ".join(f'x{i}="v{i}"' for i in range(1000)),
    "<p>a b c</p><a " + " ".join(f'x{i}="v{i}' for i in range(1001)),
    "<p>a b c</p><a " + "\"'<" * 3_000_000,
    "<p>a b c</p>" + "<a '" * 300_000,
    "<p>a b c</p><a " + "x " * 2_000_000 + "class" + " " * 1_000_000,
    "<p>a b c</p><!--" + "<!--" * 500_000,
])
def test_pages_cut_short_are_read_in_linear_time(page):
    start = time.time()
    assert main_text.extract(page, PRIOR) == "a b c"
    assert time.time() - start < 15  # a second or two; the square of it would take hours


def test_ten_megabytes_of_quotes_and_deep_nesting():
    assert main_text.extract("<p>a b c</p>" + "\"'" * 5_000_000, PRIOR).startswith("a b c")
    assert main_text.extract("<p>a" + "<b>x</i>" * 50_000, PRIOR).count("x") == 50_000


@pytest.mark.parametrize(("page", "text"), [
    (f"<html><head><title>T</title><meta charset=x><body><h1>Head</h1>{BODY}", "Head " + WORDS),
    (f"<head><script>document.write('<div>')</script><title>T</title></head><body>{BODY}", WORDS),
    (f"<html><body class='home has-sidebar'>{BODY}</body></html>", WORDS),
    (f"<body><form id=f>{BODY}<nav>menu a b</nav></form></body>", WORDS),
    (f"<div class='page-header with-sidebar'>{BODY}<div class=sidebar>side bar</div></div>", WORDS),
    (f"<div class='post'>{BODY}</div><div class='comments'>{BODY * 3}</div>", WORDS),
    ("<script>if (a<b && c>'d\" ) { x(\"</p>\") }</script>" + BODY, WORDS),
    ("<p>a &#" + "9" * 6000 + "; b &#" + "0" * 6000 + "65; c</p>", "a � b A c"),
    ("<p>a <svg> b</p><p>c</p>", "a b c"),
])
def test_missing_ends_wrappers_and_references(page, text):
    assert main_text.extract(page, PRIOR) == text
