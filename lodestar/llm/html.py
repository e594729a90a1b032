"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags. A block is known by its words and link density and by those of the block
before and after it; a decision tree grown on a small labelled table (:mod:`lodestar.llm.html_samples`) keeps or drops it.
Flags from the elements open around a block, and then from their names, are features too, but lesser ones: a node splits
on them only where words and links, its own and its neighbours', no longer tell its blocks apart as well.

Defined cases: null html is empty, and a page without kept blocks has the empty text; very long pages are read whole; rows
with one page_id, equal ones too, are pages each; an empty table gives an empty result; only the three columns named
are read, so others may have any name. Unclosed tags, comments and quotes run to the end of the page; what stands in a
``script``, ``style``, ``textarea`` or ``title`` is no markup up to its end tag (without one, tags are read on); a head ends where
something begins that does not belong in one, and tags of head and body may be left out; an element whose content is
left out (a button, say) is only one if it is closed inside the box that it stands in and before another of its name
(``svg``, ``object`` and ``template`` may hold their like), else its content counts; a link reaches over blocks up to its end tag,
without one to the end of its block; a ``br`` is white space inside its block; white space is that of ``str.split``.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import column_arrays, map_batches, text_of
from lodestar.llm.html_samples import sample_pages

# Element and class names of HTML pages.
_SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "button", "head", "title", "object", "canvas", "video", "audio"}
_BOXES = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "blockquote", "figure", "fieldset", "details", "menu", "dialog"}
_BREAKS = _BOXES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "figcaption", "hr", "address", "center", "legend", "summary", "option", "label"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice",
    "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related",
    "recommended", "comment", "comments", "respond", "replies", "widget", "toolbar", "pagination", "pager", "copyright", "legal",
    "contentinfo", "complementary", "disclaimer",
}
_STORY_TAGS = {"article", "main"}
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template", "noframes", "head", "html"}
_NESTED = {"svg", "object", "template"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: Elements whose content is text up to their own end tag, and containers in which they are not.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}
_NOT_RAW_IN = {"svg", "iframe"}
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_MAYBE_HIDDEN = re.compile(r"hidden|none", re.I)
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """A run of text between two block boundaries."""

    text: str
    words: int
    linked: int
    furniture: bool
    named: bool
    story: bool
    heading: bool
    wanted: bool = False


@dataclass
class _Box:
    tag: str
    furniture: bool = False
    named: bool = False
    strong: bool = False
    story: bool = False
    wanted: bool = False
    dropped: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    boxes: list[_Box] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    heading: bool = False

    def close_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            story = max((k for k, b in enumerate(self.boxes) if b.story), default=-1)
            inner = self.boxes[story + 1 :]
            furniture = any(b.furniture for b in inner) or any(b.strong for b in self.boxes[: story + 1])
            named = any(b.named for b in inner)
            linked = sum(len(t.split()) for t, link in self.parts if link)
            wanted = any(b.wanted for b in self.boxes) and not any(b.dropped for b in self.boxes)
            self.blocks.append(Block(text, len(text.split()), linked, furniture, named, story >= 0, self.heading, wanted))
        self.parts = []


def _hidden(attributes: str) -> bool:
    """Whether an attribute hides the element; class names and other values that contain the word do not."""
    if not _MAYBE_HIDDEN.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value.strip().lower().startswith(("false", "until")):
            return True
        if name == "style" and _NO_DISPLAY.search(value) or name == "aria-hidden" and value.strip().lower().startswith("true"):
            return True
    return False


def _box(tag: str, attributes: str) -> _Box:
    if tag in ("html", "body"):
        return _Box(tag)
    names = {w for m in _NAMED.finditer(attributes) for w in _WORDS.split((m[2] or m[3] or m[4] or "").lower())} if "=" in attributes else set()
    strong = tag in _FURNITURE_TAGS - {"header"} or _hidden(attributes)
    named = bool(names & _FURNITURE_WORDS) and tag not in _STORY_TAGS
    return _Box(tag, strong or tag == "header", named, strong, tag in _STORY_TAGS, "data-wanted" in attributes, "data-dropped" in attributes)


def _parts(m: re.Match) -> tuple[str, bool, str]:
    """Name, whether it closes, and attributes of a tag; no name for comments and the like."""
    return (m[2] or m[5] or "").lower(), (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""


def _closed(page: str, at: int, tag: str, box: str) -> int:
    """Where the content ends of an element that begins before ``at``, or -1 if it is not closed inside its box."""
    depth, boxes = 1, 1
    while m := _TOKEN.search(page, at):
        at = m.end()
        name, closing, attributes = _parts(m)
        if attributes.endswith("/") or name not in (tag, box):
            if name in _RAW and name != tag and not closing and not attributes.endswith("/") and tag not in _NOT_RAW_IN and (end := _RAW[name].search(page, at)):
                at = end.start()
        elif name == tag:
            if not closing and tag not in _NESTED:
                return -1
            depth += -1 if closing else 1
            if not depth:
                return m.start()
        else:
            boxes += -1 if closing else 1
            if not boxes:
                return -1
    return -1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out, link, reaches, head = _Page(), False, False, False
    at = 0
    unclosed = set()  # raw elements without a further end tag
    last_end: dict[str, int] = {}  # where an element's last end tag begins

    def text(raw: str) -> None:
        nonlocal head
        if head and raw.strip():
            head = False
        if raw and not head:
            out.parts.append((_html.unescape(raw) if "&" in raw else raw, link))

    def may_close(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)), default=-1)
        return last_end[tag] >= at

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag, closing, attributes = _parts(m)
        if not tag:
            continue
        if tag == "head":
            head = not closing
            continue
        if head and tag not in _IN_HEAD:
            head = False  # the first element that does not belong in a head ends it
        if tag in _RAW and tag not in unclosed and not closing and not attributes.endswith("/"):
            if end := _RAW[tag].search(page, at):
                at = end.start()
                continue
            unclosed.add(tag)
        if tag in _SKIPPED:
            if not closing and not attributes.endswith("/") and tag not in _RAW and may_close(tag):
                box = out.boxes[-1].tag if out.boxes else ""
                if (end := _closed(page, at, tag, box)) >= 0:
                    at = end
            continue
        if tag == "a":
            link = not closing
            if link:  # with an end tag of its own it reaches over blocks
                ends = _LINK.search(page, at)
                reaches = bool(ends) and ends[1] == "/"
        elif tag == "br":
            text(" ")
        elif tag in _BREAKS:
            out.close_block()
            link = link and reaches
            out.heading = tag in _HEADINGS and not closing
            if tag in _BOXES:
                if not closing:
                    if tag == "header" and any(b.story for b in out.boxes):
                        out.boxes.append(_Box(tag, wanted="data-wanted" in attributes))  # an article's own heading
                    else:
                        out.boxes.append(_box(tag, attributes))
                elif any(b.tag == tag for b in out.boxes):
                    while out.boxes.pop().tag != tag:
                        pass
    text(page[at:])
    out.close_block()
    return out.blocks


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "story", "heading", "page_story", "named")
#: Groups of features by rank: words and links, elements, names. A split is taken from the first group whose best gains at
#: least the share ``PREFERENCE`` of what the best of all gains.
GROUPS, PREFERENCE = (range(6), range(6, 10), range(10, 11)), 0.5
DEPTH, LEAST, SAMPLES, SEED = 12, 8, 240, 5


def features(found: list[Block]) -> np.ndarray:
    """One row of :data:`FEATURES` per block."""
    out = np.zeros((len(found), len(FEATURES)))
    if not found:
        return out
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], links[:-1], words[1:], links[1:]
    out[:, 6:9] = [(b.furniture, b.story, b.heading) for b in found]
    out[:, 9] = any(b.story and not b.furniture for b in found)
    out[:, 10] = [b.named for b in found]
    return out


def _best(x: np.ndarray, y: np.ndarray, columns: range, least: int) -> tuple[float, int, float]:
    """The largest fall of the Gini impurity by one limit on one of the columns: (gain, column, limit)."""
    n, share = len(y), y.mean()
    best = (0.0, -1, 0.0)
    for f in columns:
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        a, b = hits[:-1] / k, (hits[-1] - hits[:-1]) / (n - k)
        gain = np.where(ok, 2 * share * (1 - share) - (k * 2 * a * (1 - a) + (n - k) * 2 * b * (1 - b)) / n, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-9:
            best = (float(gain[at]), f, float((v[at] + v[at + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, least: int = LEAST):
    """A binary tree by Gini impurity: a leaf is a share of wanted blocks, a branch (feature, limit, low, high)."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0):
        return share
    found = [_best(x, y, g, least) for g in GROUPS]
    gain, f, limit = next(b for b in found if b[0] >= PREFERENCE * max(found)[0])
    if gain <= 0:
        return share
    low = x[:, f] <= limit
    return (f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree, x: np.ndarray) -> np.ndarray:
    """Which rows the tree keeps."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    low = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x), bool)
    out[low], out[~low] = decide(tree[2], x[low]), decide(tree[3], x[~low])
    return out


def labelled_table(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    found = [blocks(p) for p in (sample_pages(SAMPLES, SEED) if pages is None else pages)]
    return np.concatenate([features(b) for b in found]), np.array([b.wanted for bs in found for b in bs], float)


def main_texts(pages: list[str], tree) -> list[str]:
    """Kept blocks of each page, one to a line."""
    found = [blocks(p or "") for p in pages]
    keep = iter(decide(tree, np.concatenate([features(b) for b in found])).tolist() if found else ())
    return ["\n".join(b.text for b in bs if next(keep)) for bs in found]


def main_text(page: str | None, tree) -> str:
    """The main text of one page."""
    return main_texts([page or ""], tree)[0]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a narrow map, the tree travels with the tasks."""
    tree = grow(*labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pages,) = column_arrays(batch, "html")
            texts = main_texts(pages, tree)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), text_of(page).alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
