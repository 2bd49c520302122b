"""HTML extraction: hand-made pages, the given pages, the cut against all labellings."""

import html
import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablemill.llm import extraction

LONG = "This paragraph has enough words to be taken for a part of the article itself."


def test_hand_made_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>{LONG}</p>";</script><style>p{{}}</style></head><body>
    <header><a href=/>Home</a><p>{LONG} header</p></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
    <div id="cookie-notice"><p>{LONG} cookies</p></div><!-- <p>{LONG} hidden</p> -->
    <main><article class="post"><header><h1>A &amp; B</h1></header><p>{LONG}<br>Next&nbsp;line &lt;b&gt; &#233;
    <p>Short.<p><b>{LONG} second<div class="ad">{LONG} buy</div><ul><li>one <a href=x>link</a> item here<li>two</ul>
    <section class="comments"><p>{LONG} reader</p></section></article></main>
    <aside>{LONG} side</aside><form>{LONG} form<textarea>{LONG}</textarea></form><footer>&copy; {LONG} foot</footer>"""
    want = ["A & B", f"{LONG} Next line <b> é", "Short.", f"{LONG} second", "one link item here", "two"]
    assert extraction.main_text(page) == "\n\n".join(want)


def test_names_of_the_layout_are_no_boilerplate():
    page = f'<html class="no-ads"><body class="has-sidebar comments"><div class="page-with-sidebar"><p>{LONG}</p><div class="sidebar">{LONG} side</div></div>'
    assert extraction.main_text(page) == LONG


ONE, TWO, THREE = (f"{LONG} {x}" for x in ("one", "two", "three"))


@pytest.mark.parametrize("between", [
    "<svg class='i'/>", "<math/>", "<SVG viewBox='0 0 1 1' />", "<svg-icon name='x'></svg-icon>", "<video-player src=x></video-player>", "<audio-player></audio-player>",
    "<select-box></select-box>", "<title-bar></title-bar>", "<select><option>a<option>b", "<object data=x>", "<audio src=x>", "<video src=x>", "<canvas>", "<template>", "<svg><path d=x>",
    "<svg><style/><script href='x'/><path/></svg>", "<svg><title>t</title><text>hidden words</text></svg>", f"<svg><foreignObject><p>{LONG} hidden</p></foreignObject></svg>",
    f"<object data=a>{LONG} outer<object data=b>{LONG} inner</object>{LONG} outer</object>", f"<video src=x><p>{LONG} no video</p></video>", f"<template><div><p>{LONG}</p></div></template>",
    f"<select><option>{LONG}</option></select>", f"<noscript>{LONG}</noscript >", f"<script>'<svg>'</script x><canvas>{LONG}</canvas>", "<math><mi>x</mi><mo>=</mo></math>",
])
@pytest.mark.parametrize("last", ["", "<audio src=y></audio><svg><path/></svg><object>o</object><select><option>c</option></select><video></video><canvas></canvas><template></template>"])
def test_elements_that_hide_only_what_is_theirs(between, last):
    page = f"<body><article><p>{ONE}</p><div>{between}</div><p>{TWO}</p>{between}<p>{THREE}</p>{last}</article></body>"
    assert extraction.main_text(page) == "\n\n".join([ONE, TWO, THREE])


def test_raw_elements_hide_to_the_end_of_the_page():
    for name in ("script", "style", "textarea", "title", "iframe", "noscript"):
        assert extraction.main_text(f"<p>{ONE}</p><{name}><p>{TWO}</p>") == ONE


@pytest.mark.parametrize("outer", ["<article>", "<main>", "<main><article>"])
def test_slugs_inside_an_article(outer):
    for slug in ("discussion", "search", "form", "legal", "copyright", "notice", "alert", "share", "reply", "related", "related-work", "comments", "navigation", "ads"):
        page = f'<body>{outer}<h1>T</h1><p>{ONE}</p><section id="{slug}"><h2 id="{slug}">Heading</h2><p>{TWO}</p><p>{THREE}</p></section><h3 class="{slug}">Last</h3><p>{LONG}</p>'
        assert extraction.main_text(page) == "\n\n".join(["T", ONE, "Heading", TWO, THREE, "Last", LONG]), slug
    for slug in ("discussion", "legal-notice", "share"):
        for name in ("id", "class"):
            page = f'<body>{outer}<p>{ONE}</p><div {name}="{slug}"><p>{TWO} {LONG}</p><p>{THREE} {LONG}</p></div><p>{LONG}</p>'
            assert extraction.main_text(page) == "\n\n".join([ONE, f"{TWO} {LONG}", f"{THREE} {LONG}", LONG]), (slug, name)


@pytest.mark.parametrize("outer", ["<article>", "<main>", "<main><article>"])
def test_boilerplate_inside_an_article(outer):
    for part in (
        f'<section class="comments"><p>{TWO} {LONG}.</p><article class="entry"><p>{THREE} {LONG}.</p></article></section>', f'<div class="ad">{TWO}</div>', f'<div hidden id="discussion"><p>{TWO}</p></div>',
        '<div class="share"><a href=x>Share</a> <a href=y>Post</a></div>', '<div id="related"><ul><li><a href=x>Another story to read</a><li><a href=y>One more story</a></ul></div>',
        f'<nav id="discussion"><p>{TWO}</p></nav>', f'<div id="sidebar" class="sidebar"><p>{TWO}</p></div>', f'<div class="x" aria-hidden="true"><p>{TWO}</p></div>',
    ):
        assert extraction.main_text(f"<body>{outer}<p>{ONE}</p>{part}<p>{LONG}</p>") == f"{ONE}\n\n{LONG}", part


def test_names_outside_an_article_count_in_full():
    assert extraction.main_text(f'<body><div id="discussion"><p>{TWO}</p></div><article><p>{ONE}</p></article><section id="related"><h2>H</h2><p>{TWO}</p></section>') == ONE


def test_many_unclosed_elements_take_no_longer_by_the_square():
    page = f"<article><p>{ONE}</p>" + "<audio><svg><object><div>" * 20_000 + f"<p>{TWO}</p>"
    began = time.process_time()
    assert list(extraction.markup_of(page)) and time.process_time() - began < 10


@pytest.mark.parametrize("tag", [
    '<article data-title="The hidden costs of rain">', "<article title='a hidden gem'>", "<article class='comment-free ad-free'>", "<article data-hidden=0 title=it's>",
    '<article class="a"">', '<article class="a" "b>', "<article title='x > y'>", '<article data-x="a\n> b" lang=en>', "<article aria-label='display: none'>",
])
def test_attributes_are_read_as_html_does(tag):
    assert extraction.main_text(f"<body>{tag}<p class=\"a\"\">{ONE}</p><p title=it's>{TWO}</p><p>It's {THREE}</p></article>") == f"{ONE}\n\n{TWO}\n\nIt's {THREE}"


@pytest.mark.parametrize("tag", ["<div hidden>", '<div hidden="">', "<div HIDDEN id=x>", "<div style='color:red; display : none'>", "<div style=display:none>"])
def test_hidden_elements(tag):
    assert extraction.main_text(f"<article><p>{ONE}</p>{tag}<p>{TWO}</p></div><p>{THREE}</p></article>") == f"{ONE}\n\n{THREE}"


def test_signs_that_open_no_tag_are_text():
    text = "< 5 people came to the meeting, and 7 <3 it; a<b as well, they said <, or so."
    assert extraction.main_text(f"<article><p>{ONE}</p><p>{text.replace('a<b', 'a < b')}</article>") == f"{ONE}\n\n{text.replace('a<b', 'a < b')}"
    assert extraction.main_text(f"<article><p>{ONE}</p><p>{TWO}</p>< 5 people came to the meeting in the end, all of them on foot") == \
        f"{ONE}\n\n{TWO}\n\n< 5 people came to the meeting in the end, all of them on foot"
    assert extraction.main_text(f"<article><p>{ONE}</p><!--><p>{TWO}</p><!---><p>{THREE}</p>") == f"{ONE}\n\n{TWO}\n\n{THREE}"


def test_a_form_around_the_page_is_no_form_of_fields():
    page = f"<body><form id=aspnet action=/><nav><a href=/>Home</a></nav><article><p>{ONE}</p><p>{TWO}</p></article></form><form><p>{THREE}</p></form>"
    assert extraction.main_text(page) == f"{ONE}\n\n{TWO}"
    assert extraction.main_text(f"<body><form><div><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div></form>") == f"{ONE}\n\n{TWO}\n\n{THREE}"


@pytest.mark.parametrize("bit", ["<p>it's <a href='", "<p class=\"a\"\">", "<a b='", "<x \"", "< ", "<a b=\"'", "<!-", "<p title=it's>x"])
def test_a_megabyte_of_stray_quotes(bit):
    page = f"<article><p>{ONE}</p>" + bit * (1_000_000 // len(bit))
    began = time.process_time()
    extraction.blocks_of(page)
    assert time.process_time() - began < 4


def test_blocks_kept_and_dropped_on_the_given_pages():
    """Precision and recall over all words of the given pages, against their article elements."""
    import duckdb

    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    right = kept = wanted = 0
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        got = Counter(extraction.main_text(page).split())
        right, kept, wanted = right + (want & got).total(), kept + got.total(), wanted + want.total()
    print(f"precision {right / kept:.4f}, recall {right / wanted:.4f}")
    assert right / kept > 0.99 and right / wanted > 0.99


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for row in extraction.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?[ph])[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n\n".join(p for p in parts if p) and row["n_chars"] == len(row["text"])


def test_odd_pages(spark):
    odd = [None, "", "plain words without any markup, but enough of them to be kept as content.", "<", "<p", "a < b and c > d are compared in these words, right?", "<p>&#x41;&bogus;&lt;", "</p></div>", "<script>never closed <p>x", "<p>" + "w " * 50_000, "<div>" * 3000 + "x"]
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(odd)] + [(0, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    out = extraction.extract_pages(pages.withColumn("text", F.lit(1)).withColumn("parent", F.lit("p"))).collect()
    assert len(out) == len(odd) + 2
    by = {r["page_id"]: r["text"] for r in out if r["page_id"]}
    assert by[1] == "" and by[2] == odd[2] and by[5] == odd[5] and by[8] == "" and by[9] == ("w " * 50_000).strip()
    assert all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in out)
    assert extraction.extract_pages(pages.limit(0)).collect() == []


def test_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 7)
        source, sink = [rng.choice([0, rng.random() * 3]) for _ in range(n)], [rng.choice([0, rng.random() * 3]) for _ in range(n)]
        edges = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda side: sum(k if s else c for s, c, k in zip(side, source, sink, strict=True)) + sum(w for u, v, w in edges if side[u] != side[v])  # noqa: B023, E731
        got = extraction.minimum_cut(source, sink, edges)
        assert cost(got) <= min(map(cost, itertools.product([False, True], repeat=n))) + 1e-6
