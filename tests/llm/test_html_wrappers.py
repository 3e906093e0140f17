"""Wrappers whose names hold a barred word, and templates of large hosts."""

import pytest

from labelspark.llm import html_extraction as html

LONG = "words of the article that go on " * 12
WANT = " ".join(LONG.split())


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'><article><p>{LONG}</article><div class=sidebar><p>no</div></div>",
        f"<div class='page no-ads'><main><p>{LONG}</main><div class='ad'><p>no</div></div>",
        f"<div id='content-social'><p>{LONG}</div><div class='social'><p>no</div>",
        f"<form action=x><div><p>{LONG}</div><form><input name=q></form></form>",
        f"<div class='notice-page'><div class='promo'><p>no</div><article class=post><p>{LONG}</article></div>",
        f"<div class='banner-top'><div class='comments-open'><main><p>{LONG}</main></div></div>",
        f"<div class=wrap><article><p>{LONG}</article><div id=comments><p>{LONG}{LONG}no</div></div>",
        f"<div class='modal-ready'><p>{LONG}<div id=comments><p>no</div><p hidden>no</div>",
        f"<div class=has-sidebar><article><p>{LONG}</article><div class=related><article>no</article></div></div>",
    ],
)
def test_wrappers_stay_and_boxes_go(page):
    blocks, _ = html.page_blocks(page)
    assert [t for t, *_ in blocks] == [WANT]


def test_a_heading_with_paragraphs_stays():
    blocks, _ = html.page_blocks("<div class='widget-page'><h1>T</h1><p>x</p></div><div class=menu><p>no</div>")
    assert [t for t, *_ in blocks] == ["T", "x"]


def test_comments_are_no_main_text():
    blocks, _ = html.page_blocks(f"<p>own</p><div class='comments'><p>{LONG}</div>")
    assert [t for t, *_ in blocks] == ["own"]


def test_a_notice_on_few_pages_of_a_large_host_goes(spark):
    pages = [
        (i, f"http://a.org/{i}", f"<p>own text {i}</p>" + ("<div><p>Notice of 2019</p></div>" if i < 8 else ""))
        for i in range(400)
    ]
    pages += [(400 + i, f"http://a.org/in{i}", f"<main><p>own {i}<p>Said inside</main>") for i in range(8)]
    pages += [(500 + i, f"http://a.org/few{i}", f"<p>few {i}</p><p>On four pages</p>") for i in range(4)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert all(got[i] == f"own text {i}" for i in range(400))
    assert all(got[400 + i] == f"own {i}\n\nSaid inside" for i in range(8))
    assert all(got[500 + i] == f"few {i}\n\nOn four pages" for i in range(4))
