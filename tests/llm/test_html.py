"""Main text of pages."""

import random
import re
import time

import pytest

from labelspark.llm import html_extraction as html

SCHEMA = "page_id long, url string, html string"


def texts(page):
    blocks, _ = html.page_blocks(page)
    return [t for t, *_ in blocks]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two</p><p> a\n\tb&nbsp;c ", ["one", "two", "a b c"]),
        ("<article><h1>T</h1><p><b>x<br><p>y</p></article><p>out", ["T", "x", "y"]),
        ("<body><nav><a>m</a></nav><p>x</p><footer>f</footer>", ["x"]),
        ('<div class="ad">a</div><div class="main-ad"><p>b</p></div><div>c</div>', ["c"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes', ["yes"]),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>a <i>b</i> c <a href='x>y'>d</a></p>", ["a b c d"]),
        ("<main><article class='comment'><p>no</p></article><p>yes</p></main>", ["yes"]),
        ("<article><header><h1>T</h1></header><p>x</p><section id='comments'>no</section></article>", ["T", "x"]),
        ("<header><p>no</p></header><p>yes</p><form><p>no</p></form>", ["yes"]),
        ("<p hidden>no<p style='display: none'>no<p aria-hidden=true>no<p>yes", ["yes"]),
        ("<p>&lt;b&gt; &#233; &eacute; &#x4e2d;</p>", ["<b> é é 中"]),
        ("<p>unclosed <b>bold</p><p>next", ["unclosed bold", "next"]),
        ("<p>cut off <a hre", ["cut off"]),
        ("a < b and c > d", ["a < b and c > d"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_the_largest_article_is_the_main_text():
    page = "<article><p>short</p></article><article><p>much longer text</p></article>"
    assert texts(page) == ["much longer text"]


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def test_templates_go_and_copies_stay(spark):
    pages = []
    for i in range(12):
        pages.append((i, f"http://a.org/{i}", f"<div><p>Site of A</p></div><p>own text {i}</p>"))
    for i in range(12, 30):
        pages.append((i, f"http://b.org/{i}", "<div><p>Head</p></div><p>the same article</p>"))
    pages.append((30, "http://c.org/", "<div><p>Site of A</p></div><p>else</p>"))
    got = {r.page_id: r for r in html.extract(rows(spark, pages)).collect()}
    assert [got[i].text for i in range(12)] == [f"own text {i}" for i in range(12)]
    assert all(got[i].text == "Head\n\nthe same article" for i in range(12, 30))
    assert got[30].text == "Site of A\n\nelse" and got[30].n_chars == 15
    assert got[3].n_template == 1 and got[3].n_blocks == 1


def test_awkward_pages(spark):
    pages = [
        (1, None, None), (2, "", ""), (3, "no host", "<p>x"), (3, "no host", "<p>x"),
        (None, "http://h/", "<p>y"), (4, "http://h/", "<div>" * 3000 + "deep"),
        (5, "http://h/", "<p>" + "long " * 200_000),
    ]
    got = html.extract(rows(spark, pages).selectExpr("*", "1 AS text", "2 AS host", "3 AS row", "4 AS hash"))
    found = sorted(((r.page_id, r.n_chars) for r in got.collect()), key=repr)
    assert found == sorted(
        [(1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, 4), (5, 999_999)], key=repr
    )
    assert html.extract(rows(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # A quote that is never closed makes no text of its tag.
        ('<p title="oops>hello</p><p>world</p>', ["hello", "world"]),
        ("<p>it<b data-x='>s</b> fine</p>", ["its fine"]),
        ("<p title=it's>one</p><p>two 'three'</p>", ["one", "two 'three'"]),
        # Inside an article a class has to name a box as a whole; what is written stays.
        ('<article><section class="related-work"><p>a</section><p class="notice">b</article>', ["a", "b"]),
        ('<article><blockquote class="social-contract">a</blockquote><div class="promotion-of-science">b</div></article>',
         ["a", "b"]),
        ('<article><p>a</p><div class="ad-slot">x</div><div class="share buttons">y</div><ul class="related-posts"><li>z</ul></article>',
         ["a"]),
        ("<article><header><h2>Title</h2></header><p>a</article>", ["Title", "a"]),
        ("<article><p>a <span class='ad'>x</span> b</p></article>", ["a", "b"]),
    ],
)
def test_tags_and_names(page, want):
    assert texts(page) == want


HOSTILE = {
    "open quotes": '<a b="' * 170_000,
    "single quotes": "<a b='x' '" * 100_000,
    "stray ends": "<b>" * 140_000 + "</i>" * 140_000,
    "inline over blocks": "<b>" + "<div>" * 100_000 + "</b>" * 100_000 + "x",
    "deep paragraphs": "<div><p>x" * 110_000,
    "open inline before paragraphs": "<b>" * 100_000 + "<p>x" * 100_000,
    "boxes in boxes": "<div class=ad><p>x" * 50_000,
    "articles in articles": "<article><p>x" * 70_000,
    "comments": "<!--" * 250_000, "angles": "<" * 1_000_000, "raw": "<title>" * 140_000,
    "spaces": "<a " + '" ' * 400_000 + ">x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_anything_takes_linear_time(name):
    page = HOSTILE[name]
    start = time.process_time()
    html.page_blocks(page)
    assert time.process_time() - start < 8


def test_text_behind_inline_elements_counts_for_the_block():
    """The subtree hash of a paragraph that begins with an inline element tells its text."""
    hashes = [set(html.page_blocks(f"<div><p><b>{w}</b> rest {w}</p></div>")[1][1]) for w in ("one", "two")]
    assert not hashes[0] & hashes[1]


def test_template_counts_equal_brute_force(spark):
    """Deleted blocks are those in a subtree, taken as tags and words, on enough pages."""
    pick = random.Random(4)
    shared = [f"<div><p>{w} block</p><p>of the site {w}</p></div>" for w in ("red", "green", "blue")]
    pages = []
    for i in range(60):
        own = f"<div><p>own text {i}</p></div>"
        parts = [own, *pick.sample(shared, pick.randint(0, 3))]
        pick.shuffle(parts)
        pages.append((i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(parts) + "</body>"))
    got = {r.page_id: r.text for r in html.extract(rows(spark, pages), min_pages=8).collect()}
    for i, url, page in pages:
        host = [p for _, u, p in pages if u.split("/")[2] == url.split("/")[2]]
        left = [p for p in re.findall(r"<div>.*?</div>", page) if sum(p in other for other in host) < 8]
        assert got[i] == "\n\n".join(t for p in left for t in re.findall(r"<p>(.*?)</p>", p))
