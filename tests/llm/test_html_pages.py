"""Main text of labelled pages of many kinds, found by path ratios and not by names."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from voxmeter.llm import htmltext

WORDS = "stone river lamp quiet garden winter bridge letter window morning paper cloud yellow market silver corner".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rng):
    """(html, texts) of headings, paragraphs, a list, a quote and a short last word."""
    out, texts = [], []

    def add(tag, text, inner=None):
        out.append(f"<{tag}>{inner or text}</{tag}>")
        texts.append(text)

    add("h1", sentence(rng, 4))
    for _ in range(rng.randint(3, 8)):
        text = " ".join(sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(2, 6)))
        add("p", text, text.replace(" ", " <b>", 1) + "</b>")
    add("h2", "A permalink", '<a href="#x">A permalink</a>')
    out.append("<ul>")
    for k in range(4):
        add("li", f"Item {k}")
    out.append("</ul>")
    add("blockquote", sentence(rng, 12))
    add("p", "The end.")
    return "".join(out), texts


def page(rng, open_tag, close_tag, named, body=None):
    """An article among a menu, an advert, a sidebar and a footer, by elements or by plain divs with class names or without."""
    html, texts = article(rng)
    part = lambda tag, name, inner: f"<{tag}>{inner}</{tag}>" if named == "tags" else f'<div class="{name}">{inner}</div>' if named == "classes" else f"<div>{inner}</div>"
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 6))
    around = [part("header", "site-header-banner", sentence(rng, 3)), part("nav", "main-nav", f"<ul>{links}</ul>")]
    after = [part("aside", "sidebar", f"<ul>{links}</ul>"), part("footer", "site-footer", "&copy; 2020")]
    if named != "none":
        after.insert(0, part("aside", "user-comments", f"<p>{sentence(rng, 30)}</p><p>{sentence(rng, 40)}</p>"))
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a = '<p>';</script></head><body>{''.join(around)}{open_tag}{html}{close_tag}{''.join(after)}</body></html>", texts


@pytest.mark.parametrize("named", ["tags", "classes", "none"])
@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div>", "</div>"), ('<div class="overflow-hidden"><section>', "</section></div>"), ("<table><tr><td>", "</td></tr></table>")])
def test_labelled_pages(named, tags):
    for seed in range(20):
        html, texts = page(random.Random(seed), *tags, named)
        assert htmltext.main_text(html) == "\n".join(texts), (seed, html)


def test_an_article_in_a_div_beside_teaser_articles():
    rng = random.Random(1)
    html, texts = article(rng)
    teasers = "".join(f'<article><h3><a href="/{k}">{sentence(rng, 5)}</a></h3><p>{sentence(rng, 9)}</p></article>' for k in range(6))
    got = htmltext.main_text(f"<body><div><div>{html}</div><div>{teasers}</div></div></body>").split("\n")
    assert [t for t in got if t in texts] == texts


def test_a_whole_page_in_a_form():
    html, texts = article(random.Random(2))
    assert htmltext.main_text(f'<body><form action="/"><nav><a href="/">Home</a></nav><div>{html}</div></form></body>') == "\n".join(texts)


@pytest.mark.parametrize("attributes", ["class='tags-line'", "class='legal-news'", "class='ad-free'", "id='with-sidebar'"])
def test_names_are_weights(attributes):
    rng = random.Random(3)
    html, texts = article(rng)
    more = " ".join(sentence(rng, 15) for _ in range(5))
    assert htmltext.main_text(f"<article>{html}<p {attributes}>{more}</p></article>") == "\n".join([*texts, more])


def test_the_ratios_decide():
    """Without names, and without thresholds on the ratios, what is around the article comes along."""
    for seed in range(20):
        html, texts = page(random.Random(seed), "<div>", "</div>", "none")
        found = htmltext.Page(html)
        assert htmltext.content(found) == texts
        assert len(htmltext.content(found, factor=float("inf"), low=0)) == len(found.blocks) > len(texts)


class Article(HTMLParser):
    """The blocks of a page's article element, read by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.parts, self.blocks = 0, [], []
        self.feed(page)
        self.close()

    def end_block(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag not in htmltext.INLINE:
            self.end_block()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag not in htmltext.INLINE:
            self.end_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_the_pages_of_the_table(spark, sf_dir, monkeypatch):
    """Every page gives its article. Without names and elements most pages still do, as their ratios say; without ratios none does."""
    rows = [r for r in htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()]
    whole = [r.text for r in rows]
    assert len(rows) > 20 and whole == ["\n".join(Article(r.html or "").blocks) for r in rows]
    judged, path_values = htmltext.judged, htmltext.path_values
    monkeypatch.setattr(htmltext, "judged", lambda *a: (1.0, judged(*a)[1]))
    monkeypatch.setattr(htmltext, "OUTSIDE", 1.0)
    assert sum(htmltext.main_text(r.html) != t for r, t in zip(rows, whole, strict=True)) <= 0.3 * len(rows)
    monkeypatch.setattr(htmltext, "path_values", lambda page: (np.where(np.isfinite(path_values(page)[0]), 0.0, -np.inf), np.ones(len(page.blocks))))
    assert sum(htmltext.main_text(r.html) != t for r, t in zip(rows, whole, strict=True)) == len(rows)


def test_markup_is_read_as_html_does():
    assert htmltext.main_text("<p data-x=Bob's>Hello there, this is it's own text.</p><p>More.</p>") == "Hello there, this is it's own text.\nMore."
    assert htmltext.main_text('<p title="a > b">One, two.</p><p title=\'c > d\'>Three, four.<p x = "5>4">Five.') == "One, two.\nThree, four.\nFive."
    assert htmltext.main_text('<p title="open>One, two.</p>') in ("", "One, two.")


@pytest.mark.parametrize("opened, closed", [("<div>", "</div>"), ("<span>", "</span>"), ("<div><p>", "</div>"), ("<ul><li>", "</ul>"), ("<button><p>", ""), ("<div a=\"", "")])
def test_time_grows_with_length(opened, closed):
    began = time.time()
    htmltext.main_text(opened * 60_000 + "<p>Words, in the middle.</p>" + closed * 60_000)
    assert time.time() - began < 15
