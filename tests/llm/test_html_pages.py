"""Extraction: forms of pages, labelled pages with precision and recall, the given pages, hostile pages."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
from tidemark.llm import queries
from tidemark.llm.html_extract import main_text

LONG = "This is a paragraph of the article that goes on for some time, as paragraphs do."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><p>{LONG}</p><div class="ad-slot">Buy one get one free, today only, in all of our many shops.</div><p>{LONG}</p></article>', f"{LONG} {LONG}"),
        (f'<article><p>{LONG}</p></article><section><h3>12 replies</h3><div>{LONG} I think so too.</div><div>{LONG} So do I.</div></section>', LONG),
        (f"<article><p>{LONG}</p><h2>3 responses to this</h2><div>{LONG} I think so too.</div></article>", LONG),
        (f"<div><p>{LONG}</p></div><div>We use cookies to make this site better. Accept all of them?</div>", LONG),
        (f"<div><p>{LONG}</p></div><div>Copyright 2024 The Paper. All rights reserved.</div>", LONG),
        ("<p>Short note.</p><p>Ok.</p>", "Short note. Ok."),
        (f'<article><p>{LONG}</p><h2>Sources</h2><ul><li><a href="/a">A first long source, 2001</a></li><li><a href="/b">A second</a></li></ul></article>', f"{LONG} Sources A first long source, 2001 A second"),
        (f"<article><p>{LONG}</p><p>Baking cookies: we like our cookies warm.</p><p>{LONG}</p></article>", f"{LONG} Baking cookies: we like our cookies warm. {LONG}"),
        (f"<article><h1>Comments in code</h1><p>{LONG}</p><h2>Discussion</h2><p>{LONG}</p></article>", f"Comments in code {LONG} Discussion {LONG}"),
        (f'<nav><a href="/">Home</a></nav><div class="recipe cookies"><p>{LONG}</p></div>', LONG),
        (f"<article><p>{LONG}</p><p>All rights reserved.</p></article>", f"{LONG} All rights reserved."),
        (f"<div><p title='a > b' lang=\"<x>\">{LONG}</p></div><p title=\"open>{LONG}</p>", f"{LONG} {LONG}"),
        (None, ""),
        ("", ""),
        ("<nav><ul><li><a href=/>Home</a></li></ul></nav>", ""),
    ],
)
def test_forms(page, text):
    assert main_text(page) == text


class Article(HTMLParser):
    """The blocks inside of article elements, by the standard library's parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.block = 0, [], []

    def end_block(self) -> None:
        text = " ".join("".join(self.block).split())
        self.blocks += [text] if text and self.depth else []
        self.block = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p", "br"):
            self.end_block()
            self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.end_block()
            self.depth -= tag == "article"

    def handle_data(self, data):
        self.block.append(data)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/pages.parquet").exists(), reason="needs the given tables")
def test_given_pages_whole(spark):
    def expected(page):
        parser = Article()
        parser.feed(page or "")
        parser.close()
        return " ".join(parser.blocks)

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = {r.page_id: r.text for r in queries.QUERIES["op2_extract_text"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {i: expected(page) for i, page in pages.items()}


def labelled_page(rng: random.Random) -> tuple[str, str]:
    """A page in one of several layouts and the text of its article."""
    words = ["river", "stone", "lamp", "the", "of", "and", "water", "under", "bridge", "été", "night", "old"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    paragraphs = [sentence(rng.randrange(8, 60)) for _ in range(rng.randrange(2, 12))]
    title = sentence(6)[:-1]
    body = [f"<h1>{title}</h1>"] + [f"<p>{p}</p>" for p in paragraphs]
    promo = [f'<div class="{rng.choice(["ad", "ad-slot", "sponsored-box", "newsletter-signup"])}">{sentence(12)}</div>', f'<aside>{sentence(15)}</aside>']
    for block in rng.sample(promo, rng.randrange(3)):
        body.insert(rng.randrange(1, len(body) + 1), block)
    start, end = rng.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="post-content">', "</div>"), ("<div id=c17><section>", "</section></div>")])
    menu = "".join(f'<li><a href="/{i}">{rng.choice(words)}</a></li>' for i in range(rng.randrange(3, 12)))
    head = rng.choice([f"<nav><ul>{menu}</ul></nav>", f'<div class="menu"><ul>{menu}</ul></div>', f"<div><ul>{menu}</ul></div>"])
    notice = rng.choice(["", "<div>We use cookies to serve you better. Accept?</div>", '<div id="cookie-banner"><p>Cookies help us to help you, as our policy says at length.</p></div>'])
    reader = [f"<div>{sentence(rng.randrange(5, 40))}</div>" for _ in range(3)]
    comments = rng.choice(["", f'<section class="comments">{"".join(reader)}</section>', f"<section><h3>3 comments</h3>{''.join(reader)}</section>"])
    foot = rng.choice(["<footer>About us and more of us.</footer>", "<div>© 2024 The Paper</div>", '<div class="footer"><p>Made with care in the old town by the river.</p></div>'])
    script = "<script>var a='<p>no</p>';</script><style>p{}</style>"
    return f"<html><body>{script}{head}{notice}{start}{''.join(body)}{end}{comments}{foot}</body></html>", " ".join([title, *paragraphs])


def test_labelled_pages_precision_and_recall():
    rng, right, kept, wanted = random.Random(4), 0, 0, 0
    for _ in range(1500):
        page, text = labelled_page(rng)
        found = main_text(page)
        right += len(text) if text == found else sum(len(s) + 1 for s in text.split(". ") if s in found)
        kept += len(found)
        wanted += len(text)
    assert right / wanted > 0.98
    assert right / kept > 0.98


@pytest.mark.parametrize(
    "unit, tail",
    [("<a ", ""), ("<div>", "x</foo>"), ("</foo>", "x"), ("<center>", "<dt></dt>"), ("<h1>2 replies", ""), ("<dt><ul>", "<dd></dd>"), ("<!-- ", ""), ('<p class="', ""), ("<li><b>x", ""), ("copyright ", "2024"), ("cookies we ", "."), ('<p ">"', ""), ("""<p a="'>""", ""), ("<a", ""), ("<!x", ""), ("""<p '">""", "'"), ("<a <b>", '"')],
)
def test_hostile_pages_take_time_in_step_with_their_length(unit, tail):
    def seconds(n: int) -> float:
        k = n // (len(unit) + len(tail))
        page = unit * k + tail * k
        begun = time.process_time()
        main_text(page)
        return time.process_time() - begun

    assert seconds(320_000) < 8 * seconds(80_000) + 1
