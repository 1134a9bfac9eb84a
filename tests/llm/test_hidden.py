"""Hidden elements by their attributes, and links inside the main text."""

from __future__ import annotations

import pytest

from voxmeter.llm import htmltext


@pytest.mark.parametrize("attributes", ['class="overflow-hidden"', 'data-title="hidden costs"', 'title="aria-hidden=true"', 'style="overflow: hidden"', 'hidden="false"', 'data-role="banner"'])
def test_shown(attributes):
    assert htmltext.main_text(f"<body><div {attributes}><p>First words, that count.</p></div></body>") == "First words, that count."


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "class=x HIDDEN", "aria-hidden=true", 'style="color: red; display : none"', "style='display:none'"])
def test_not_shown(attributes):
    assert htmltext.main_text(f"<body><p>Main, text.</p><div {attributes}><p>Other words, unseen.</p></div></body>") == "Main, text."


def test_links_in_the_main_text_stay():
    page = '<article><h2><a href="#x">A permalink</a></h2><p>Long text, with many words, and marks.</p><ul><li><a href="/y">One item</a></li></ul><p><a href="/z">Only a link.</a></p></article>'
    assert htmltext.main_text(page) == "A permalink\nLong text, with many words, and marks.\nOne item\nOnly a link."
