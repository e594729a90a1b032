import hashlib
import os
import re
import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from lodestar.llm import html, warc
from lodestar.llm.html_samples import KINDS, sample_pages
from lodestar.sources.workspace import new_path

TREE = html.grow(*html.labelled_table())
STORY = "The council met on Monday and spoke for hours about the new bridge before it agreed to build it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href='/'>Home</a></nav><article><h1>Bridge</h1><p>{STORY}<br>And more.</p><p>Yes.</p></article><footer>All rights</footer>", f"Bridge\n{STORY} And more.\nYes."),
        (f"<article><p>A &amp; B &lt;c&gt;&nbsp; &#233;</p><script>var a='<p>no</p>'</script><style>p{{}}</style><p>{STORY}</p></article>", f"A & B <c> é\n{STORY}"),
        (f"<header><h1>Site</h1></header><main><p>{STORY}</p><aside>Read this too</aside><form><label>Mail</label></form></main><div class='cookie-notice'>{STORY}</div>", STORY),
        (f"<article><p>{STORY}</p><section id='comments'><p>{STORY}</p></section></article><div class='ad'>Buy</div>", STORY),
        (f"<article><p>{STORY}</p><!-- <p>hidden</p> --><p>Last & end", f"{STORY}\nLast & end"),
        ("", ""),
        (None, ""),
        ("<nav>only <a href='x'>menu</a>", ""),
        ("<article><p>unclosed <b>bold <a href='", "unclosed bold"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, TREE) == text


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++)f(i);</script>",
        "<SCRIPT type='a'>s = '<!--';</Script >",
        "<style>a::after{content:'<b'}</style>",
        "<textarea>1 <a \" 2</textarea>",
    ],
)
def test_raw_text_is_no_markup(raw):
    assert html.main_text(f"<article>{raw}<p>{STORY}</p>{raw}<p>{STORY}</p></article>", TREE) == f"{STORY}\n{STORY}"
    assert html.main_text(f"<head>{raw}<title>a <b</title></head><body><article><p>{STORY}</p></article></body>", TREE) == STORY


def test_raw_text_without_an_end():
    assert html.main_text(f"<head><title>Site<body><article><p>{STORY}</p></article>", TREE) == STORY


@pytest.mark.parametrize(
    "attributes",
    ["class='wrap overflow-hidden'", 'style="overflow:hidden"', "class=hidden-xs", "title='not hidden'", "data-hidden='true'", "aria-hidden='false'", "hidden=false", "data-x='display:none'"],
)
def test_only_hiding_attributes_hide(attributes):
    for page in (f"<div {attributes}><article><p>{STORY}</p></article></div>", f"<article {attributes}><p>{STORY}</p></article>"):
        assert html.main_text(page, TREE) == STORY


@pytest.mark.parametrize("attributes", ["hidden", "class='a' HIDDEN", "hidden=''", "hidden='hidden'", 'style="color:red; display : none"', "style=display:none", "aria-hidden=true", "aria-hidden='true'"])
def test_hidden_boxes_are_furniture(attributes):
    assert html.main_text(f"<div {attributes}><article><p>{STORY}</p></article></div><article><p>{STORY}</p></article>", TREE) == STORY


def test_tree_fits_its_table():
    x, y = html.labelled_table()
    assert (html.decide(TREE, x) == (y > 0)).mean() > 0.99


@pytest.mark.parametrize("kind", KINDS)
def test_held_out_pages(kind):
    x, y = html.labelled_table(sample_pages(200, 99, (kind,)))
    assert (html.decide(TREE, x) == (y > 0)).mean() > 0.99


@pytest.mark.parametrize("kind", KINDS)
def test_neighbours_decide(kind):
    """With the neighbours' words and links dealt anew, many decisions change, and for the worse."""
    x, y = html.labelled_table(sample_pages(200, 99, (kind,)))
    dealt = x.copy()
    dealt[:, 2:6] = x[np.random.default_rng(0).permutation(len(x)), 2:6]
    before, after = html.decide(TREE, x), html.decide(TREE, dealt)
    assert (before != after).mean() > 0.05 and (after == (y > 0)).mean() < (before == (y > 0)).mean() - 0.05


def test_pages_without_any_class_or_id():
    bare = lambda p: re.sub(r' (class|id)="[^"]*"', "", p)
    pages = sample_pages(200, 99, ("elements",))
    _, y = html.labelled_table(pages)
    x, _ = html.labelled_table([bare(p) for p in pages])
    assert (html.decide(TREE, x) == (y > 0)).mean() > 0.95


def test_page_without_a_story_box():
    links = "".join(f'<li><a href="/{k}">go {k}</a></li>' for k in range(6))
    body = "".join(f"<p>{STORY} Part {k} of it.</p>" for k in range(4))
    page = f"<div><ul>{links}</ul></div><div><h1>The bridge</h1>{body}</div><div><ul>{links}</ul></div>"
    assert html.main_text(page, TREE) == "\n".join(["The bridge", *[f"{STORY} Part {k} of it." for k in range(4)]])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the shared tables are absent")
class _Article(HTMLParser):
    """The text of article elements by the standard library's parser: a second opinion on blocks."""

    BREAKS = set("div section article ul ol dl table blockquote figure p h1 h2 h3 h4 h5 h6 li dt dd tr td th figcaption pre hr aside nav header footer form".split())
    SKIPPED = set("script style noscript template iframe svg select button object".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.dropped, self.parts, self.lines = 0, 0, [], [], []

    def _close(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(text)
        self.parts = []

    def handle_starttag(self, tag, attributes):
        names = dict(attributes)
        self.inside += tag == "article"
        self.skip += tag in self.SKIPPED
        if tag in self.BREAKS:
            self._close()
            if self.inside and tag in ("div", "aside", "nav", "form", "section", "figure", "ul", "ol"):
                named = set(re.split("[^a-z]+", f"{names.get('class', '')} {names.get('id', '')}".lower()))
                self.dropped.append(tag in ("aside", "nav", "form") or bool(named & html._FURNITURE_WORDS))

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self._close()
            if self.inside and tag in ("div", "aside", "nav", "form", "section", "figure", "ul", "ol") and self.dropped:
                self.dropped.pop()
        self.inside -= tag == "article"
        self.skip -= tag in self.SKIPPED

    def handle_data(self, data):
        if self.inside and not self.skip and not any(self.dropped):
            self.parts.append(data)


def _article(page):
    parser = _Article()
    parser.feed(page)
    parser.close()
    parser._close()
    return "\n".join(parser.lines)


def test_given_pages_are_their_articles():
    """Every page of the table, whose article element is known; names of classes make no difference to nearly all."""
    pages = [r[0] or "" for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    want = [_article(p) for p in pages]
    assert all(want) and html.main_texts(pages, TREE) == want
    without = html.main_texts([re.sub(r' class="[^"]*"', "", p) for p in pages], TREE)
    assert sum(a != b for a, b in zip(without, want, strict=True)) <= 0.02 * len(pages)


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=utf-8><article><p>{s}</p></article>", "<title>t</title><link href=x><article><p>{s}</p></article>", "<html><head><style>x</style><body><article><p>{s}</p></article></body>",
        "<head><noscript><link href=x></noscript><script>1</script><article><p>{s}</p></article>", "<head><title>t</title></head><article><p>{s}</p></article>",
        *[f"<body><div><{t}>Go</div><article><p>{{s}}</p></article><{t}>x</{t}></body>" for t in ("button", "select", "noscript", "object")],
        *[f"<body><{t}>Go<article><p>{{s}}</p></article><{t}>x</{t}></body>" for t in ("button", "select")],
        *[f"<body><article><{t}>Go<p>{{s}}</p></article></body>" for t in ("button", "select", "noscript", "object", "iframe", "canvas")],
    ],
)
def test_no_page_is_lost(page):
    assert STORY in html.main_text(page.replace("{s}", STORY), TREE)


def test_closed_elements_are_left_out():
    page = f"<article><p>{STORY}</p><svg><g><svg><text>in</text></svg><text>out</text></g></svg><button>Go</button><select><option>one</select><p>{STORY}</p><object><object>a</object>b</object></article>"
    assert html.main_text(page, TREE) == f"{STORY}\n{STORY}"


def test_links_reach_over_blocks():
    card = "<a href=x><h3>A teaser of some words</h3><p>and one more line of it</p></a>"
    assert [b.linked for b in html.blocks(f"<div>{card}<p>plain</p></div>")] == [5, 6, 0]
    assert [b.linked for b in html.blocks("<p><a href=x>open link<p>next block<p><a href=y>closed</a>")] == [2, 0, 1]
    page = f"<div><div>{card * 3}</div><div><h1>Title</h1><p>{STORY}</p><p>{STORY}</p></div><div>{card * 3}</div></div>"
    assert html.main_text(page, TREE).splitlines() == ["Title", STORY, STORY]


def test_many_unclosed_elements_take_linear_time():
    page = "<div>" * 3000 + "<button>x" * 3000 + "<svg>" * 3000 + f"<p>{STORY}</p>"
    began = time.perf_counter()
    assert STORY in "\n".join(b.text for b in html.blocks(page)) and time.perf_counter() - began < 5


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", f"<article><p>{STORY}</p></article>"), (None, None, "<nav><p>x"), (2, "u", "<article>" + "<p>word word</p>" * 5000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([0, len(STORY), 0, 5000 * 10 - 1]) and all(len(r["text"]) == r["n_chars"] for r in got)
    assert html.extract(df.limit(0)).count() == 0


BIG, OTHER = "é" * 600, "x" * 1500
PAGES = [
    (1, "http://a/1", BIG), (2, None, BIG), (5, "http://a/\r\n5", BIG), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", OTHER), (8, "u", OTHER), (8, "v", OTHER),
    (None, "u", OTHER), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "z" * 300_000), (13, "u", "z" * 300_000),
]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = warc.archive(df).collect()
    assert len(got) == len(PAGES)
    one = {r["page_id"]: r for r in got if r["page_id"] != 8}
    for i, _, h in PAGES:
        if i != 8:
            raw = (h or "").encode()
            assert (one[i]["payload_bytes"], one[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    kinds = {i: (one[i]["record_type"], one[i]["refers_to"]) for i in one}
    assert kinds[5] == ("response", None) and kinds[1] == kinds[2] == ("revisit", 5)
    assert kinds[3] == kinds[4] == kinds[6] == kinds[10] == kinds[11] == ("response", None)
    assert kinds[12] == ("revisit", 13) and kinds[13] == ("response", None) and kinds[7] == ("revisit", 8) == kinds[None]
    assert {(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 8} == {("response", None), ("revisit", 8)}


def test_records_are_found_by_the_index(spark):
    path = new_path(spark, "warc")
    df = spark.createDataFrame([(i, "u", f"page {i} " * (i * 400)) for i in range(60)], "page_id long, url string, html string")
    index = warc.write(df, path).collect()
    assert len(index) == 60 and max(r["frame"] for r in index) > 0
    for r in index[::7]:
        headers, block = warc.read_record(r["bundle"], r["frame"], r["offset"], r["length"])
        assert headers["WARC-Record-ID"] == f"<{r['record_id']}>"
        i = int(r["record_id"].split(":")[2])
        assert block.split(b"\r\n\r\n", 1)[1] == (f"page {i} " * (i * 400)).encode()


def test_bundles_are_plain_zstandard(spark):
    import zstandard

    path = new_path(spark, "warc")
    row = warc.write(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"), path).first()
    with open(row["bundle"], "rb") as f:
        raw = f.read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: response") and plain.endswith(b"hello\r\n\r\n")


def test_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
