import html
import itertools
import random
import re

import pytest

from quillwork.llm import html_text as ht
from tests.llm.helpers import rows, table


@pytest.fixture(scope="module")
def weights():
    return ht.trained()


def test_pages_give_their_articles(spark, sf):
    got = rows(ht.op1_html_text(spark, sf)).set_index("page_id")
    pages = table(sf, "pages").set_index("page_id")
    assert len(got) == len(pages)
    for page_id, page in pages.html.items():
        article = page[page.find("<article>") + 9 : page.find("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(p for p in parts if p)
        assert got.text[page_id] == text and got.n_chars[page_id] == len(text)


def test_min_cut_is_least():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) * rng.random() for _ in range(n)]
        pairs = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def energy(labels, gain=gain, pairs=pairs):
            return -sum(g for g, x in zip(gain, labels, strict=True) if x) + sum(w for a, b, w in pairs if labels[a] != labels[b])

        best = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(ht.min_cut(gain, pairs)) - best) < 1e-9


def test_unseen_generated_pages(weights):
    rng = random.Random(77)
    wrong = 0
    for _ in range(60):
        page, content = ht._generated(rng)
        expected = [b.text for b in ht.blocks(page) if any(w in content for w in b.text.split()[:2])]
        wrong += ht.main_text(page, weights) != "\n".join(expected)
    assert wrong <= 2


def test_boilerplate_goes(weights):
    p = "Long enough running text of the article, with several words and an end."
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><div class='cookie-notice'>We use cookies <button>OK</button></div>"
        "<nav><a href='/'>Home</a></nav><article><h1>Title&nbsp;&amp; more</h1>"
        f"<p>{p}<script>var t='</p>';</script></p><p>a &lt; b\n  c</p><aside class='ad'>Buy now.</aside><p>{p}</p></article>"
        "<form><label>Name</label><input><select><option>x</option></select></form>"
        "<section id='comments'><div class='comment'><p>I disagree with this article, it is long and wrong.</p></div></section><footer>&copy; me</footer></body></html>"
    )
    assert ht.main_text(page, weights) == f"Title & more\n{p}\na < b c\n{p}"


@pytest.mark.parametrize("page", ["", "<", "<p", "</", "<!--", "<!-- x", "<script>a", "<p>", "</p></div>", "&amp", "<a href='x>y", "<<<>>>", "a" * 10, "<div>" * 3000, "<b>" * 3000 + "x"])
def test_broken_markup(weights, page):
    assert isinstance(ht.main_text(page, weights), str)


def test_awkward_tables(spark):
    from pyspark.sql import functions as F

    page = "<article><h1>A title here</h1><p>Words of the text that is the article, quite long enough to be seen as such.</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("h", F.lit(1)).withColumn("text", F.lit("x"))
    got = rows(ht.extract(df))
    assert len(got) == 4 and sorted(got.n_chars.tolist()) == [0, 0, *[len(got.text.max())] * 2]
    assert rows(ht.extract(df.limit(0))).empty


@pytest.mark.parametrize(
    "page,texts",
    [
        ('<p title="a > b" class=\'x>y\'>Text', ["Text"]),
        ('Kept <div class="x y', ["Kept"]),
        ("Kept <p title='never closed", ["Kept"]),
        ("AT&<b>amp;</b>T", ["AT&amp;T"]),
        ("x &lt;b&gt; &amp;lt; &#x41;&copy", ["x <b> &lt; A©"]),
        ("a < b, 3 <4 and <- x", ["a < b, 3 <4 and <- x"]),
        ("<!-->a<!--->b<!-- <p> > -->c", ["abc"]),
        ("x</ y>z<?php echo '<p>'; ?>w", ["xz'; ?>w"]),
        ("<a href=u/\"v>link</a> text", ["link text"]),
        ("<p>one<p>two<ul><li>a<li>b</ul>three", ["one", "two", "a", "b", "three"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<script>if (a < b) { '</p>' }</script  >after<style>p{}</style>", ["after"]),
    ],
)
def test_markup_is_read_as_browsers_do(page, texts):
    assert [b.text for b in ht.blocks(page)] == texts


def test_time_grows_with_the_page_alone():
    import time

    for shape in ("{b}{ei}", "<i><div>{b}{ei}", "{b}{h}", "{p}", "{d}"):
        took = []
        for n in (2000, 16000):
            page = shape.format(b="<b>" * n, ei="</i>" * n, h="<h2>x" * n, p="<p x='>a" * n, d="<div>x" * n)
            begin = time.perf_counter()
            ht.blocks(page)
            took.append(time.perf_counter() - begin)
        assert took[1] < 8 * 6 * took[0] + 0.5, shape


SENTENCE = "The river had risen overnight, and the lower meadow lay under a sheet of brown water until noon."
OTHER = "Nobody in the village could remember a spring so wet; the older men spoke of it for years afterwards."


@pytest.mark.parametrize(
    "page",
    [
        # A blog in plain divs.
        f"""<!DOCTYPE html><html><body><div id="wrapper"><div class="top-nav"><a href="/">Start</a> <a href="/about">About</a> <a href="/c">Contact</a></div>
        <div class="content"><h1>High water</h1><p>{SENTENCE}</p><p>{OTHER} {SENTENCE}</p><p>{OTHER}</p></div>
        <div class="sidebar"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>
        <div class="footer">All rights reserved. <a href="/p">Privacy policy</a></div></div></body></html>""",
        # Tables and no class names, with quoted > and broken tags.
        f"""<html><body><table width=100%><tr><td><a href=/>Home</a> | <a href=/n>News</a> | <a href=/l>Links</a></td></tr>
        <tr><td><h1>High water</h1><p title="a > b">{SENTENCE}<p>{OTHER} {SENTENCE}<p>{OTHER}</td></tr></table><script>document.write("<p>x</p>")</script><div class="x""",
        # Sections, an advert in the middle, a form and comments behind.
        f"""<body><header><h2><a href="/">The Paper</a></h2></header><main><section><h1>High water</h1><p>{SENTENCE}</p><div class="advert">Buy boots now!</div><p>{OTHER} {SENTENCE}</p><p>{OTHER}</p></section></main>
        <form action="/s"><label>Your mail</label><input name=m><button>Subscribe</button></form><div id="comments"><p>Great piece, I was there and it was just so.</p></div></body>""",
    ],
)
def test_hand_written_pages_without_an_article_element(weights, page):
    assert ht.main_text(page, weights) == f"High water\n{SENTENCE}\n{OTHER} {SENTENCE}\n{OTHER}"


def test_a_slash_closes_no_element_of_html(weights):
    p = "Long enough running text of the article, with several words and an end."
    body = f"<article><h1>Title</h1><p>{p}</p>{{}}<p>{p}</p></article>"
    for leak in ('<script src="a.js"/>var leak=1;</script>', "<style/>p{color:red} leak</style>", '<textarea name="a"/>leak</textarea>'):
        assert ht.main_text(body.format(leak), weights) == f"Title\n{p}\n{p}"
    assert ht.main_text(body.format("<svg viewBox='0 0 1 1'/>"), weights) == f"Title\n{p}\n{p}"
    linked = ht.blocks("<div><a href=/x/>Menu of links</a></div>")
    assert [b.linked for b in linked] == [1.0]
    assert [b.text for b in ht.blocks("<div/>one</div><p/>two")] == ["one", "two"]


def test_hidden_elements_go(weights):
    p = "Long enough running text of the article, with several words and an end."
    for hidden in ("hidden", "hidden=''", 'style="color:red;display: none"', "style=display:none"):
        page = f"<body><article><h1>Title</h1><p>{p}</p><p>{p}</p></article><div {hidden}><p>Do not show this to anyone.</p></div></body>"
        assert "anyone" not in ht.main_text(page, weights), hidden
    kept = f"<body><article><h1>Title</h1><p data-x='hiddenness'>{p}</p></article></body>"
    assert p in ht.main_text(kept, weights)
