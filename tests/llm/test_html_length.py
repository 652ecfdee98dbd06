"""Broken and deeply nested pages take time in proportion to their length."""

from __future__ import annotations

import time

import pytest

from stockledger.llm import html

PAGE = "<body><article><p>The text of the page.</p></article>"


@pytest.mark.parametrize(
    "unit",
    ["<a href=x ", '<a "', "<a '", "<!--", "<!x", "<a", "<", '<a" "', "<div>x", "<div class='a1'><article>", "<div>x</p>", "<li>", "</div>", "<script>", "&", '"<a'],
)
def test_a_megabyte(unit):
    started = time.perf_counter()
    for page in (PAGE + unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">" + PAGE):
        blocks = html.blocks_of(page)
        html.main_text(blocks, html.best_path(blocks))
    assert time.perf_counter() - started < 12
    assert "The text of the page." in html.main_text(html.blocks_of(PAGE + unit * 100), "body/article")


def test_tags_that_are_not_closed_are_text():
    assert [b.text for b in html.blocks_of("<p>1 <a <b>bold</b> 3 < 4 <i x='>'>5</i>")] == ["1 <a bold 3 < 4 5"]
