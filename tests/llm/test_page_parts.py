"""What markup says of a page, and pages without an article that copy each other."""

import pytest

from pairscreen.llm import page_text


@pytest.mark.parametrize(
    "page",
    [
        '<html class="no-header"><body>{}</body></html>',
        '<body class="single has-sidebar">{}</body>',
        '<body><main class="no-header" id="ads">{}</main></body>',
        '<body><article class="post comments-open" role="menu">{}</article></body>',
    ],
)
def test_page_and_article_are_never_dropped(page):
    assert [t for t, _ in page_text.blocks(page.format("<p>text</p>"))] == ["text"]


def test_parts_of_names_inside_an_article():
    page = (
        '<article><h1 class="post-header">one</h1><h2 id="social-history">two</h2><h2 id="comments">three</h2>'
        '<section id="related-work"><p class="ad_hoc">four</p></section><div class="header"><p>five</p></div>'
        '<div class="wide ad">no</div><div role="navigation">no</div><p>six</p></article>'
        '<div class="site-header">no</div>'
    )
    assert [t for t, _ in page_text.blocks(page)] == ["one", "two", "three", "four", "five", "six"]


def test_copies_without_an_article_keep_their_text(spark):
    def page(*parts):
        return "<div>Site menu</div>" + "".join(f"<p>{p}</p>" for p in parts) + "<p>All rights</p>"

    long = [f"paragraph {i} of a text that several addresses show" for i in range(12)]
    rows = [(i, f"http://a.example/x/1?v={i}", page(*long)) for i in range(4)]
    rows += [(5, "http://a.example/x/1/print", page(*long[:-1], "one more"))]
    rows += [(6, "http://a.example/y/1", page("another text"))]
    rows += [(10 + i, f"http://b.example/{i}", page(*long)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages).collect()}
    assert len({got[i] for i in range(4)}) == 1
    for i in [*range(4), 10, 11, 12]:
        assert [p for p in long if p not in got[i]] == []
    assert [p for p in long[:-1] if p not in got[5]] == [] and "one more" in got[5]
    assert "Site menu" not in got[5] and got[6] == "another text"
