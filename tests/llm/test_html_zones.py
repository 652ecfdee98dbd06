from __future__ import annotations

import pytest

from stockledger.llm import html


def text(body: str) -> str:
    blocks = html.blocks_of(f"<html><body>{body}</body></html>")
    return html.main_text(blocks, html.best_path(blocks))


@pytest.mark.parametrize(
    "body",
    [
        "<div class='layout has-sidebar'><p>one</p><p>two</p></div>",
        "<div class='site no-sidebar'><article><p>one</p><p>two</p></article></div>",
        "<article class='post comments-open'><p>one</p><p>two</p></article>",
        "<article><section id='related-work'><p>one</p></section><section id='social-media'><p>two</p></section></article>",
        "<article><h2 id='header-files'>one</h2><p>two</p></article>",
        "<div class='sidebar'><main><p>one</p><p>two</p></main></div>",
        "<article class='widget'><p>one</p><p>two</p></article>",
    ],
)
def test_names_that_only_hold_a_dropped_word_drop_nothing(body):
    assert text(body) == "one\ntwo"


@pytest.mark.parametrize(
    "zone", ["class='sidebar-left'", "id='user-comments'", "class='cookie-notice'", "class='x ad'", "role='navigation'", "id='navBar'"]
)
def test_whole_names_of_zones_are_left_out(zone):
    assert text(f"<article><p>one</p><div {zone}><p>gone</p></div><p>two</p></article>") == "one\ntwo"


def test_comments_written_as_articles_stay_out():
    assert text("<article><p>one</p></article><div id='comments'><article class='comment'><p>gone</p></article></div>") == "one"


LONG = "words of the article " * 9


@pytest.mark.parametrize(
    "wrap",
    [
        "<article><div class='wrap'><div class='lead'><p>short</p></div><div class='text'><p>{}</p></div></div></article>",
        "<main><div class='grid'><section class='b'><p>short</p></section><section class='a'><p>{}</p></section></div></main>",
        "<article><div class='head'><p>short</p></div><div><div><div class='text'><p>{}</p></div></div></div></article>",
    ],
)
def test_articles_in_parts_are_whole_and_links_beside_them_stay_out(wrap):
    assert text(wrap.format(LONG)) == "short\n" + LONG.strip()
    links = "<div class='more'><p><a href='/'>" + "other pages " * 9 + "</a></p></div>"
    assert text("<div class='page'>" + wrap.format(LONG) + links + "</div>") == "short\n" + LONG.strip()
