from __future__ import annotations

import pytest

from stockledger.llm import html


def page(body: str, wrap: str = "<article>{}</article>") -> str:
    return (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/'>Menu words here</a></ul></nav><div class='ad'>Buy now, buy a lot of things today</div>"
        + wrap.format(body)
        + "<div id='user-comments'><p>First! I read all of this and have much to say about it, at length</p></div>"
        "<footer>&copy; all rights</footer></body></html>"
    )


def text(source: str) -> str:
    blocks = html.blocks_of(source)
    return html.main_text(blocks, html.best_path(blocks))


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<h1>Title &amp; more</h1><p>One\n  two<br>three</p><p><b>four</b> five", "Title & more\nOne two three\nfour five"),
        ("<p>&lt;b&gt; &#233;&eacute; &nbsp; x</p><ul><li>a<li>b</ul>", "<b> éé x\na\nb"),
        ("<p>in</p><aside>side</aside><form>field<input></form><div class='cookie-notice'>ok?</div><p>out</p>", "in\nout"),
        ("<table><tr><td>c1<td>c2</table><!-- <p>gone</p> --><p>end", "c1\nc2\nend"),
        ("<p title='a>b'>kept</p>a < b <3 text", "kept\na < b <3 text"),
    ],
)
def test_blocks_and_what_is_left_out(body, expected):
    assert text(page(body)) == expected


@pytest.mark.parametrize("source", ["", "   ", "<p>", "<!-- open", "<script>x", "</div></p>", "<nav>only a menu</nav>", "<a<b<c"])
def test_pages_without_text(source):
    assert text(source) in ("", "<a<b<c")


def test_hosts_vote_and_odd_pages_fall_back(spark):
    wrap = "<div class='post p{n}'>{{}}</div>"
    long = "<p>" + "some words of the article " * 8 + "</p>"
    rows = [(i, f"http://U@Host.example:80/{i}", page(long, wrap.format(n=i)), "x") for i in range(5)]
    # A page of the host with more text in another box still gives the host's box.
    rows.append((5, "https://host.example/5?q", page("<p>short one</p>", "<div class='post p9'>{}</div><div class='extra'>" + long * 3 + "</div>"), "x"))
    rows += [(6, "https://host.example/6", page(long, "<section>{}</section>"), "x"), (7, "no address", page(long), "x"), (8, None, None, "x"), (9, "http://e.example/", "", "x"), (9, "http://e.example/", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3)
    winners = {r.host: r.path for r in html.winners(html.votes(pages)).collect()}
    assert winners["host.example"] == "body/div.post.p0"
    found = html.extracted(pages).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    expected = " ".join(("some words of the article " * 8).split())
    assert all(texts[i] == expected for i in (0, 1, 2, 3, 4, 6, 7)) and texts[5] == "short one" and texts[8] == texts[9] == ""
    assert html.extracted(pages.limit(0)).count() == 0
