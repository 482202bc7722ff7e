"""Main text against an independent reader of pages made here, and page shapes that a rule on element names gets wrong."""

import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from waymesh.llm import htmltext
from waymesh.llm.htmltext import main_text

LONG = "<p>" + "Many words make a paragraph long enough to count as text. " * 4 + "</p>"
WORDS = ("Many words make a paragraph long enough to count as text. " * 4).strip()


class Reader(HTMLParser):
    """All text inside ``article`` but what is in ``skip`` elements or classes; block elements part it."""

    BLOCKS = {"p", "h1", "h2", "li", "div", "br", "article", "ul", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.parts = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.append(tag)
            return
        if tag in ("nav", "aside", "footer", "form", "script", "style") or dict(attrs).get("class") in ("ad", "comments"):
            self.skip = [tag]
        self.depth += tag == "article"
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        self.depth -= tag == "article"
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts[-1] += data

    def text(self):
        return " ".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in self.parts) if x)


def made_page(rnd):
    say = lambda n: " ".join(rnd.choice(["été", "green", "a", "&amp;", "&lt;b&gt;", "x&nbsp;y", "<i>in</i>line", "don't", "house\n", "1 < 2"]) for _ in range(n))
    body = [f"<h1>{say(rnd.randint(0, 6))}</h1>"]
    for _ in range(rnd.randint(0, 12)):
        body.append(rnd.choice([
            lambda: f"<p>{say(rnd.randint(1, 60))}</p>", lambda: f"<p>{say(3)}<br>{say(2)}", lambda: f"<ul><li>{say(2)}<li>{say(4)}</ul>", lambda: f"<blockquote>{say(20)}</blockquote>",
            lambda: f'<div class="ad"><p>{say(30)}</p></div>', lambda: f"<aside>{say(9)}</aside>", lambda: f"<form>{say(3)}<input value='>'></form>", lambda: f"<script>var x = '<p>{rnd.random()}';</script>",
            lambda: f"<p title=\"a > b\" data-x=don't>{say(5)}</p>", lambda: "<!-- <p>gone</p> -->",
        ])())
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>{say(5)}</a></ul></nav><div class='ad'>{say(20)}</div><article>{''.join(body)}</article><div class='comments'><p>{say(40)}</p></div><footer>{say(5)}</footer></body></html>"


def test_articles_equal_an_independent_reader():
    rnd = random.Random(11)
    for _ in range(400):
        page = made_page(rnd)
        reader = Reader()
        reader.feed(page)
        assert main_text(page) == reader.text(), page


@pytest.mark.parametrize("page,want", [
    # an article that is only a teaser does not bound the text
    (f'<div class=story>{LONG * 3}</div><article class="card"><h2>Other</h2><p>A teaser of some other story, with over forty characters.</p></article>', " ".join([WORDS] * 3)),
    (f"<div>{LONG * 3}</div><article>Short</article>", " ".join([WORDS] * 3)),
    # wrappers whose class mentions furniture
    (f'<div class="page-with-sidebar"><h1>Head</h1>{LONG}</div>', f"Head {WORDS}"),
    (f'<div class="layout sidebar-right">{LONG * 2}<div class="sidebar">Side</div></div>', f"{WORDS} {WORDS}"),
    (f"<form id=page><article><p>One.</p></article><p>{WORDS}</p></form>", WORDS),
    # names that only look like furniture
    ('<article><p class="related-work">Related work.</p><div class="notice-board">Board</div><p class="ad">Buy</p><p>End.</p></article>', "Related work. Board End."),
    # quotes inside values
    ("<article><p data-x=don't>One.</p><p>Don't stop</p></article>", "One. Don't stop"),
    ('<article><p title="never closed>One.</p><p>Two.</p></article>', "One. Two."),
    # without an article: the first short line, and paragraphs next to a very long one, stay
    (f"<p>By Ann.</p>{LONG * 2}", f"By Ann. {WORDS} {WORDS}"),
    ("".join(f"<p>{c * n}</p>" for c, n in zip("abcde", (50, 120, 130, 110, 4000))), " ".join(c * n for c, n in zip("abcde", (50, 120, 130, 110, 4000)))),
    # only furniture
    ("<article></article><div class=ad>Only an advert is here, but it is a long one, long enough to be a surge.</div>", ""),
    ("<form><p>Please log in here to continue, with your own name and word.</p></form>", ""),
    (f'<article><p>Short story.</p></article><div id="comments">{LONG * 3}</div>', "Short story."),
    # links
    (f"<div><a href=1>First section of this site</a> <a href=2>Second section of this site</a></div><div></div><div></div>{LONG}", WORDS),
    ("", ""), ("<p>&am &amp", "&am &"), ("<article><p>cut off</p><p class=", "cut off"),
])
def test_shapes(page, want):
    assert main_text(page) == want


FAR = f"<div><div>Home</div></div><div><div><div>{LONG}</div></div></div><div><div><div>Imprint</div></div></div>"


def test_the_distribution_decides(monkeypatch):
    assert main_text(FAR) == WORDS
    monkeypatch.setattr(htmltext, "window_sums", lambda lengths, window=3: np.full(len(lengths), 10**6))
    assert main_text(FAR) == f"Home {WORDS} Imprint"


@pytest.mark.parametrize("unit", ['<a href="x ', "<b><p>", "<div>", "<li>", "<!-- ", "<p a='", "x <table><tr><td>", "<ul><b><li>", "</p>", "<", "&amp", '<p class="a', "<div class=ad>"])
def test_time_is_linear_in_length(unit):
    times = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        main_text(unit * (size // len(unit)))
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 1


def test_window_sums():
    x = np.array([5, 0, 0, 0, 7, 1], np.int64)
    assert htmltext.window_sums(x).tolist() == [5, 0, 7, 8, 8, 1]
    assert htmltext.stretches(x, htmltext.window_sums(x)) == [(0, 1), (4, 6)]
