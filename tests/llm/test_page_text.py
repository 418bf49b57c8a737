"""Main text of pages: planted pages, malformed markup, and the cut against all labellings."""

import itertools
import os
import random
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerocal.llm import queries as corpus
from aerocal.llm.mincut import keep_side
from aerocal.llm.page_text import extract_text, labelled_blocks, main_text, page_blocks

FOLDER = "/root/testdata/sf0.001"
BODY = [
    "The river rose for three days before anyone in the valley noticed the colour of the water.",
    "By the fourth morning the bridge had gone, and with it the only road to the market town.",
    "People crossed in small boats, carrying bread and letters and, once, a piano.",
    "It was over in a week.",
]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)
TEXT = " ".join(BODY)


def test_article_among_everything_else():
    html = f"""<!DOCTYPE html><html><head><title>News</title><style>p{{}}</style>
    <script>var a = "<article><p>no</p></article>";</script></head><body class="has-sidebar comments-open">
    <header><a href="/">Daily</a><form><input value=x><label>Search</label><button>Go</button></form></header>
    <nav><ul><li><a href=a>Home</a></li><li><a href=b>World</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site better for all of our readers. Accept them.</p></div>
    <article><header class="entry-header"><h1>The flood</h1></header>{PARAGRAPHS}
    <div class="ad">Buy the finest boots in the valley, now at half the price, only this week and only here.</div>
    <aside>Also read: what the bridge cost and who paid for it in the end.</aside>
    <footer>Filed under <a href=x>Rivers</a></footer></article>
    <section id="comments"><h2>2 comments</h2><article class="comment"><p>{BODY[0]} I was there myself and saw it.</p>
    </article></section>
    <aside class="sidebar"><h3>Popular</h3><p>{BODY[1]}</p></aside>
    <footer>&copy; 2024 Daily. All rights reserved.</footer></body></html>"""
    assert main_text(html) == f"The flood {TEXT}"


@pytest.mark.parametrize(
    "inside",
    [
        f"<main>{PARAGRAPHS}</main>",
        f"<div id=content>{PARAGRAPHS}</div>",
        f"<div class='post-body'><div>{PARAGRAPHS}</div></div>",
        f"<table><tr><td><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><td>{PARAGRAPHS}</table>",
        PARAGRAPHS,
        "<br><br>".join(BODY),
    ],
)
def test_pages_without_article(inside):
    html = (
        "<body><div id=nav><a href=a>Home</a> <a href=b>World</a></div><div class=menu><ul><li><a href=c>Sport</a></ul></div>"
        f"{inside}<div id='footer'>Contact us</div><p><a href=z>Imprint</a></p></body>"
    )
    assert main_text(html) == TEXT


def test_short_paragraphs_stay_with_their_neighbours():
    html = f"<div><p>{BODY[0]}</p><p>So</p><p>{BODY[1]}</p></div>"
    assert main_text(html) == f"{BODY[0]} So {BODY[1]}"
    assert main_text("<div><p>So</p></div>") == ""


def test_references_and_white_space():
    html = "<article><p>a&amp;b &lt;c&gt; &quot;d&quot; &#233;&#x20AC;&nbsp;&nbsp;e &amp &copy2 &bogus; &am</p><p>\n x\t y<br>z</p></article>"
    assert main_text(html) == 'a&b <c> "d" é€ e & ©2 &bogus; &am x y z'
    assert main_text("<article>a <b>b</b>c<i> d</i> 1 < 2 <3 e</article>") == "a bc d 1 < 2 <3 e"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p><b>one two<br><p>three</p></article>", "one two three"),
        ("<article><p>one<p>two<ul><li>three<li>four</ul>five", "one two three four five"),
        ("<article><p>one<!-- <p>no</p> -->two<!-- open <p>x", "onetwo"),
        ("<article><p>one<script>if (a < b) '</p>'</script> two<style>x", "one two"),
        ("<article><p class='a>one</p><p id=\"x\">two</p>", "one two"),
        ("<article><p title='a > b'>one</p></div></span></p></article>", "one"),
        ("<article><p>one</p><p hidden>no</p><p style='display: none'>no</p><div aria-hidden=true>no</div>", "one"),
        ("<article><p>one <button>no<div>no</div></button>two<select><option>no</select></p>", "one two"),
        ("<ARTICLE><P>One</P></ARTICLE>", "One"),
        ("<article><p>one <span class=ad>buy it</span> two</p></article>", "one two"),
        ("", ""),
        ("   ", ""),
        ("<", ""),
        ("<article", ""),
        ("plain words only", ""),
        ("<nav>x</nav>", ""),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


def test_long_pages_are_read_whole_and_in_linear_time():
    begun = time.time()
    many = "".join(f"<p>Sentence number {i} of the long report.</p>" for i in range(60_000))
    assert main_text(f"<article>{many}</article>").endswith("Sentence number 59999 of the long report.")
    # blocks near the border between the labels, so that the cut itself has work
    unsure = "".join(f"<div><p>{'w ' * (i * 7 % 25)}</p></div>" for i in range(20_000))
    assert len(labelled_blocks(unsure)) == 19_200
    one = "word " * 400_000
    assert main_text(f"<article><p>{one}</p></article>") == one.strip()
    for hard in ("<a href='", "<div>" , "<p", "<!--", "<b>", "</", "<li>", "&amp;", "<i></b>", "<table><td>"):
        main_text(hard * 40_000)
    assert time.time() - begun < 60


def cost(labels, gain, edges):
    return sum(-g for g, x in zip(gain, labels) if x) + sum(w for i, j, w in edges if labels[i] != labels[j])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_cut_is_the_best_labelling_that_keeps_most(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    gain = [rng.randint(-8, 8) for _ in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 7)) for _ in range(rng.randint(0, 16))]
    every = [(cost(x, gain, edges), -sum(x), x) for x in itertools.product([False, True], repeat=n)]
    assert keep_side(gain, edges) == list(min(every)[2])


def test_query_rows(spark):
    rows = [
        (1, "u", f"<article>{PARAGRAPHS}</article>", "x", 1), (1, "u", f"<article>{PARAGRAPHS}</article>", "x", 1),
        (None, None, "<article>lone</article>", "x", 1), (3, "v", None, "x", 1), (4, "w", "", None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {(1, "u", TEXT, len(TEXT)), (None, None, "lone", 4), (3, "v", "", 0), (4, "w", "", 0)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 5 and set(found) == want
    blocks = page_blocks(pages).where("page_id = 1").collect()
    assert sorted({(b.position, b.text, b.kept) for b in blocks}) == [(i, x, True) for i, x in enumerate(BODY)]
    assert extract_text(pages.limit(0)).collect() == []
    wide = spark.createDataFrame([(7, "<article>\U0001f600é</article>", "u")], "id long, body string, url string")
    assert extract_text(wide, "id", "url", "body").first().n_chars == 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_registered_query(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    want = con.execute(corpus.oracle_sql()["op13_page_text"]).fetchall()
    assert {tuple(r) for r in corpus.op13_page_text(spark, FOLDER).collect()} == set(want)
