"""Main text of web pages by removal of what recurs on a site.

Each page is parsed into elements. An element's subtree (tags and words) is hashed, and Spark
counts per host on how many pages with different content a subtree occurs. Subtrees that recur
on many pages of their host are its template and are deleted, with all that is in them. Copies
of a whole page count as one page, so an article that is served under many addresses is not
taken for a template. Inside an ``article`` or ``main`` element a subtree must recur on most
pages of the host, since what stands there is content unless it stands everywhere.

Elements that say by their tag, role or class that they are menus, forms, adverts, notices,
comments and the like go too, also on hosts with few pages. A class, an id or a form says so of a box, not of
a wrapper: it bars nothing that holds the page's main element, its article, its heading with
paragraphs, or most of its paragraphs. Of what is left the text of the
largest ``article``, or else ``main``, or else the body is given, block by block.

Inside ``article`` and ``main`` a class has to name a box as a whole (``ad-slot``, not
``related-work``), and none bars what is written there, such as paragraphs and quotations.

Parsing and hashing happen once, where the page lies, in time that grows with the page's length
whatever stands in it; what goes on is the page's blocks of text and its elements with their
hashes and parents. Counts are partial sums, so one host or one
subtree with a third of all pages is spread over tasks.

Defined cases: null or empty html gives an empty text; a null or broken url is a host of its
own (no name); repeated rows each give a row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import slices
from labelspark.session import materialize

# A subtree on at least so many different pages of a host is template, whatever the host's size;
# inside article and main it must also be on at least that share of them.
MIN_PAGES = 5
MIN_SHARE_INSIDE = 0.5

# Elements without content, elements that begin a block, and what a start tag
# closes before it.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
    .split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())
SAME_KIND = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Tags, roles and words of class or id that are never main text.
BARRED_TAGS = frozenset(
    "aside button canvas datalist dialog footer head iframe input menu nav noframes noembed "
    "noscript object script select style svg template textarea title audio video map".split()
)
BARRED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu "
    "menubar toolbar".split()
)
BARRED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment "
    "comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager widget toolbar skip teaser "
    "outbrain taboola".split()
)
# What readers add is not main text, however long it is.
COMMENT_WORDS = frozenset(
    "comment comments commentlist disqus reply replies respond".split()
)
# Paragraphs of a page that are fewer characters than this say nothing about a wrapper.
MIN_PARAGRAPHS = 200
# Words that may stand beside a barred one in a class inside article or main: the class then
# still names a box of that kind, not what a text is about.
BOX_WORDS = frozenset(
    "area articles bar block box buttons container content form group inline item items label "
    "link links list panel posts section slot stories unit wrapper wrap".split()
)
# What is written, not a box: inside article and main no class bars it.
WRITTEN = frozenset("blockquote code em figure h1 h2 h3 h4 h5 h6 p pre strong table".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
WORDS = re.compile(r"[a-z0-9]+")
ATTRIBUTE = re.compile(
    r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)",
    re.I,
)
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I) for tag in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# How an element is barred by itself: not, as a box that may turn out to be a wrapper, as
# readers' comments, for good.
OPEN, BOX, COMMENTS, SHUT = range(4)


def _named(value: str) -> int:
    """How class or id words bar a box outside article and main: any barred word does."""
    words = WORDS.findall(value)
    if BARRED_WORDS.isdisjoint(words):
        return OPEN
    return BOX if COMMENT_WORDS.isdisjoint(words) else COMMENTS


def _named_inside(value: str) -> int:
    """Inside article and main a whole name has to say so: it begins with a barred word and holds
    others only for kinds of boxes."""
    bar = OPEN
    for name in value.split():
        words = WORDS.findall(name)
        if words and words[0] in BARRED_WORDS and all(w in BARRED_WORDS or w in BOX_WORDS for w in words):
            bar = max(bar, BOX if COMMENT_WORDS.isdisjoint(words) else COMMENTS)
    return bar


def _bar(tag: str, attributes: str, inside: bool) -> int:
    if tag in BARRED_TAGS:
        return SHUT
    bar = BOX if tag == "form" else OPEN
    if not attributes:
        return bar
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if inside:
                if tag not in WRITTEN:
                    bar = max(bar, _named_inside(value))
            elif tag not in ("body", "html", "article", "main") or "comment" in value:
                bar = max(bar, _named(value))
        elif name == "role" and value in BARRED_ROLES:
            return SHUT
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return SHUT
        elif name == "style" and HIDDEN.search(value):
            return SHUT
    return bar


# Elements that are looked for below and above others, as bits.
BITS = {"main": 1, "article": 2, "h1": 4}
MAIN_PARTS = BITS["main"] | BITS["article"]


class _Element:
    """An open or closed element. What is said of the elements around or inside it is kept on it,
    so that no chain of parents is walked for each block."""

    __slots__ = (
        "tag", "bar", "barred", "inside", "parent", "digest", "size", "heading", "closed", "shut",
        "in_p", "told", "below", "above", "number",
    )

    def __init__(self, tag: str, parent: _Element | None, bar: int):
        self.tag, self.parent, self.bar, self.barred = tag, parent, bar, False
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.digest = xxhash.xxh64(tag)
        self.size, self.heading, self.closed = 0, False, False
        self.shut = self.in_p = False
        self.told = self.below = self.above = 0
        self.number = -1


def _settle(blocks: list[tuple[_Element, str]], elements: list[_Element], root: _Element) -> None:
    """Open the boxes that are wrappers; what stands in a barred element is barred too.

    ``elements`` has inner ones first, so one way through hands down, the other sums up.
    """
    if any(e.bar in (BOX, COMMENTS) for e in elements):
        for e in reversed(elements):
            e.shut = e.bar == SHUT or e.parent.shut
            e.in_p = e.tag == "p" or e.parent.in_p
        for owner, text in blocks:
            if owner.in_p and not owner.shut:
                owner.told += len(text)
        for e in elements:
            e.parent.told += e.told
        for e in elements:
            own = BITS.get(e.tag, 0)
            if own and (e.bar != OPEN or e.shut or not (e.size or e.tag == "h1")):
                own = 0
            if e.tag == "article" and 2 * e.size < root.told:
                own = 0
            e.parent.below |= e.below | own
        for e in elements:
            if e.bar not in (BOX, COMMENTS):
                continue
            wrapper = e.below & MAIN_PARTS or (e.told and e.below & BITS["h1"])
            if e.bar == BOX and not root.below & MAIN_PARTS:
                wrapper = wrapper or (e.told >= MIN_PARAGRAPHS and 2 * e.told > root.told)
            if wrapper:
                e.bar = OPEN
    for e in reversed(elements):
        e.barred = e.bar != OPEN or e.parent.barred


def _tag_end(html: str, at: int, missing: set[str]) -> tuple[int, int]:
    """(end of the attributes, end of the tag) of a tag whose name ends at ``at``. Only a quote
    behind an equals sign holds a value; one that is never closed holds nothing, so its tag ends
    at the next ``>``. ``missing`` remembers which quotes do not come any more."""
    while True:
        found = STOP.search(html, at)
        if found is None:
            return len(html), len(html)
        sign, place = found[0], found.start()
        if sign == ">":
            return place, place + 1
        at = place + 1
        before = place - 1
        while html[before].isspace():
            before -= 1
        if html[before] != "=" or sign in missing:
            continue
        close = html.find(sign, at)
        if close < 0:
            missing.add(sign)
        else:
            at = close + 1


class _Page:
    """Open elements, blocks and closed elements while a page is read; every step takes time for
    what it opens or closes only."""

    def __init__(self):
        self.root = _Element("#page", None, OPEN)
        self.stack, self.blocks, self.done = [self.root], [], []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.words: list[str] = []
        self.owner = self.root

    def say(self, text: str) -> None:
        if not self.words:
            self.owner = self.stack[-1]
        self.words.append(text)

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.words)).split())
        self.words.clear()
        if text:
            owner = self.owner
            while owner.closed:
                owner = owner.parent
            self.blocks.append((owner, text))
            owner.size += len(text)
            owner.digest.update(text.encode("utf-8", "surrogatepass"))

    def push(self, element: _Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(element)

    def pop_to(self, depth: int) -> None:
        if self.words and any(e.bar != OPEN for e in self.stack[depth:]):
            self.flush()
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.places[element.tag].pop()
            if element.tag in BLOCK:
                self.block_places.pop()
            parent = element.parent
            element.closed = True
            parent.size += element.size
            parent.digest.update(element.digest.digest())
            parent.heading |= element.heading or element.tag in HEADINGS
            self.done.append(element)

    def end(self, tag: str, block: bool) -> None:
        depth = (self.places.get(tag) or [0])[-1]
        # An inline end tag closes no block.
        if depth and (block or not self.block_places or self.block_places[-1] <= depth):
            self.pop_to(depth)

    def implied_end(self, wanted: set[str], scope: set[str]) -> None:
        """Close the outermost open element of ``wanted`` inside the nearest of ``scope``."""
        low = max((self.places[t][-1] for t in scope if self.places.get(t)), default=0)
        found = []
        for tag in wanted:
            places = self.places.get(tag) or []
            at = bisect_right(places, low)
            found += places[at : at + 1]
        if found:
            self.flush()
            self.pop_to(min(found))


P_SCOPE = {"td", "th", "li", "blockquote", "div", "section", "article", "main", "button"}


def parse(html: str) -> tuple[list[tuple[_Element, str]], list[_Element], _Element]:
    """(blocks: element and text, in page order; elements, inner ones first; the page)."""
    page, missing = _Page(), set()
    at = said = 0
    while (start := html.find("<", at)) >= 0:
        slash, tag, attributes = "", None, ""
        if html[start + 1 : start + 2] in ("!", "?"):
            comment = html.startswith("<!--", start)
            end = html.find("-->", start + 4) + 3 if comment else html.find(">", start) + 1
            if end == (2 if comment else 0):
                end = len(html)
        elif name := NAME.match(html, start + 1):
            slash, tag = name[1], name[2].lower()
            last, end = _tag_end(html, name.end(), missing)
            attributes = html[name.end() : last]
        else:
            at = start + 1
            continue
        if start > said:
            page.say(html[said:start])
        at = said = end
        if tag is None:
            continue
        block = tag in BLOCK or tag in BARRED_TAGS
        if tag == "br":
            page.say(" ")
            continue
        if block:
            page.flush()
        if slash:
            page.end(tag, block)
            continue
        if tag in ENDS_P:
            page.implied_end({"p"}, P_SCOPE)
        if tag in SAME_KIND:
            page.implied_end(*SAME_KIND[tag])
        if tag in VOID:
            continue
        parent = page.stack[-1]
        element = _Element(tag, parent, _bar(tag, attributes, parent.inside))
        if element.bar != OPEN:
            page.flush()
        if attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        page.push(element)
        if tag in RAW:
            found = RAW_ENDS[tag].search(html, at)
            page.pop_to(len(page.stack) - 1)
            at = said = found.end() if found else len(html)
    if said < len(html):
        page.say(html[said:])
    page.flush()
    page.pop_to(1)
    _settle(page.blocks, page.done, page.root)
    return page.blocks, page.done, page.root


def _main(elements: list[_Element]) -> _Element | None:
    """The largest article, else the largest main, that is not barred."""
    for e in reversed(elements):
        e.above = e.parent.above | BITS.get(e.parent.tag, 0)
    for tag in ("article", "main"):
        found = [
            e for e in elements
            if e.tag == tag and not e.barred and e.size and not e.above & BITS[tag]
        ]
        if found:
            return max(found, key=lambda e: e.size)
    return None


def page_blocks(html: str):
    """(blocks: text, element's number; elements: parent's number, subtree hash, whether inside
    article or main, and the hash of what the page says).

    Only elements with text around blocks that may stay are numbered, outer ones first.
    """
    blocks, elements, root = parse(html)
    chosen = _main(elements)
    whole = xxhash.xxh64()
    ups, hashes, inside, kept = [], [], [], []
    # -2: nothing in it stays; -1: stays, with no hash of its own around it.
    root.number = -1 if chosen is None else -2
    for e in reversed(elements):
        e.number = e.parent.number
        if e is chosen:
            e.number = -1
        if e.barred or (e.tag == "header" and not (e.inside and e.heading)):
            e.number = -2
        if e.number == -2 or not e.size or e.tag in ("html", "body"):
            continue
        ups.append(e.number)
        e.number = len(hashes)
        hashes.append(e.digest.intdigest() - (1 << 63))
        inside.append(e.inside)
    for owner, text in blocks:
        if owner.number != -2:
            kept.append((text, owner.number))
            whole.update(text.encode("utf-8", "surrogatepass") + b"\n")
    return kept, (ups, hashes, inside, whole.intdigest() - (1 << 63))


PARSED = (
    "page_id long, url string, content long, ups array<int>, hashes array<long>, "
    "inside array<boolean>, ats array<int>, texts array<string>"
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, content, ups, hashes, inside, ats, texts) of every page."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "html"):
            found = [page_blocks(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url").cast(pa.string()),
                    pa.array([e[3] for _, e in found], pa.int64()),
                    pa.array([e[0] for _, e in found], pa.list_(pa.int32())),
                    pa.array([e[1] for _, e in found], pa.list_(pa.int64())),
                    pa.array([e[2] for _, e in found], pa.list_(pa.bool_())),
                    pa.array([[a for _, a in k] for k, _ in found], pa.list_(pa.int32())),
                    pa.array([[t for t, _ in k] for k, _ in found], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "content", "ups", "hashes", "inside", "ats", "texts"],
            )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/?#]*//([^/?#:]*)", 1))
    return (
        pages.select("page_id", "url", "html").mapInArrow(run, PARSED).withColumn("host", host)
    )


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash, share): subtrees on at least ``min_pages`` different pages of a host."""
    contents = parsed.select("host", "content").distinct()
    hosts = contents.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return (
        parsed.select("host", "content", F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
        .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
        .join(hosts, "host")
        .select("host", "hash", (F.col("n") / F.col("pages")).alias("share"))
    )


RESULT = "page_id long, url string, text string, n_chars long, n_blocks int, n_template int"


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page without the blocks that stand in a subtree of ``gone``."""
    for batch in batches:
        rows = []
        columns = [batch.column(n).to_pylist() for n in ("ups", "hashes", "ats", "texts", "gone")]
        for ups, hashes, ats, texts, gone in zip(*columns):
            kept = texts
            if gone:
                gone, dead = set(gone), []
                for up, own in zip(ups, hashes):  # parents come first
                    dead.append((up >= 0 and dead[up]) or own in gone)
                kept = [t for at, t in zip(ats, texts) if at < 0 or not dead[at]]
            text = "\n\n".join(kept)
            rows.append((text, len(text), len(kept), len(texts) - len(kept)))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), *made],
            names=["page_id", "url", "text", "n_chars", "n_blocks", "n_template"],
        )


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_template): blocks kept, joined by an empty
    line, and how many went with a template."""
    parsed = materialize(
        parsed_pages(pages).withColumn("row", F.monotonically_increasing_id()), "parsed-pages"
    )
    site = materialize(templates(parsed, min_pages), "site-templates")
    pairs = F.array_distinct(F.arrays_zip("hashes", "inside"))
    asked = parsed.select("row", "host", F.explode(pairs).alias("a")).select(
        "row", "host", F.col("a.hashes").alias("hash"),
        F.when(F.col("a.inside"), MIN_SHARE_INSIDE).otherwise(0.0).alias("least"),
    )
    gone = materialize(
        asked.join(site, ["host", "hash"]).filter("share >= least")
        .groupBy("row").agg(F.collect_set("hash").alias("gone")),
        "page-templates",
    )
    joined = parsed.select("row", "page_id", "url", "ups", "hashes", "ats", "texts").join(gone, "row", "left")
    return joined.drop("row").mapInArrow(_left, RESULT)
